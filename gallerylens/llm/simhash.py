"""SimHash near-duplicates by a binary trie self-join.

Two fingerprints of 64 bits that differ in at most two bits agree in two of four blocks of 16 bits.  For each
choice of two blocks these go first; the 32 bits in front name a node of a binary trie with no error spent,
and below it pairs of nodes descend together, adding up differing bits and dropped once the budget is spent.
A descent from one root alone could not be dealt out: a pair may spend its two errors on the first bits, so that
every task would need the nodes two errors away from its own, 1 + n + n (n - 1) / 2 of them at n levels.
Nodes of one choice are dealt out by their 32 bits.  A node with very many fingerprints is split at a further
eight levels: each fingerprint goes to its own child and, for children further on, to those within the budget.

Equal fingerprints are one leaf, so copies are never paired.  A batch passes on a spanning forest of the
links it finds, not every link, which leaves the components as they are.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import raw, stored, texts
from .components import connected_components

SHINGLE, SEED, BUDGET, SPLIT_BITS, SPLIT_AT, SALTS = 3, 42, 2, 8, 20_000, 8


def fingerprint(text: bytes, words: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit SimHash of a text in UTF-8; no word: zero; fewer words than a shingle has: all of them at once."""
    found = text.lower().split()
    if not found:
        return 0
    shingles = zip(*(found[i:] for i in range(words)), strict=False) if len(found) >= words else [found]
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return bits_of(np.fromiter((digest(join(s), seed) for s in shingles), np.uint64, max(1, len(found) - words + 1)))


def bits_of(hashes: np.ndarray) -> int:
    """The SimHash of 64-bit hashes: the bits set in over half of them."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 15):
        ones += np.unpackbits(hashes[k : k + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes)).view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint's bits as a signed long."""

    def run(batches):
        for batch in batches:
            prints = np.array([fingerprint(t) for t in raw(batch.column("text"))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints)], ["doc_id", "fp"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def trie_pairs(bits: np.ndarray, starts: np.ndarray, bucket: np.ndarray | None = None, budget: int = BUDGET) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs (i < j) of one trie node whose low 32 bits differ in at most budget places.

    bits: by node sorted uint32, distinct in a node; starts: first row of each node, and the number of rows.
    bucket: the child by whose split a node's rows are here, or -1: pairs without a row of that child are
    another task's.  All pairs of trie nodes of one level are traversed at once.
    """
    keys = np.repeat(np.arange(len(starts) - 1, dtype=np.uint64), np.diff(starts)) << np.uint64(32) | bits
    many = np.diff(starts) > 1
    al, ah = starts[:-1][many], starts[1:][many]
    bl, bh, diff = al, ah, np.zeros(len(al), np.int8)
    for level in range(31, -1, -1):
        bit = np.uint64(1 << level)

        def middle(lo: np.ndarray, hi: np.ndarray, bit=bit) -> np.ndarray:
            return np.clip(np.searchsorted(keys, (keys[lo] & ~(bit | (bit - np.uint64(1)))) | bit), lo, hi)

        am, bm = middle(al, ah), middle(bl, bh)
        own = al == bl  # both nodes are the same: its two children meet once
        parts = [(al, am, bl, bm, diff), (am, ah, bm, bh, diff), (al, am, bm, bh, diff + 1), (am[~own], ah[~own], bl[~own], bm[~own], diff[~own] + 1)]
        al, ah, bl, bh, diff = (np.concatenate(c) for c in zip(*parts, strict=True))
        live = (diff <= budget) & (al < ah) & (bl < bh) & ((al != bl) | (ah - al > 1))
        if bucket is not None and level == 32 - SPLIT_BITS:
            home = bucket[np.minimum(al, len(bits) - 1)]
            child = lambda lo: (bits[np.minimum(lo, len(bits) - 1)] >> np.uint32(level)).astype(np.int64)
            live &= (home < 0) | (child(al) == home) | (child(bl) == home)
        al, ah, bl, bh, diff = al[live], ah[live], bl[live], bh[live], diff[live]
    return np.minimum(al, bl), np.maximum(al, bl)


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """(node, smallest node) links that connect what the links a-b connect."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    return [(x, r) for x in list(root) if (r := find(x)) != x]


def _links(batches):
    """Rows sorted by (choice, front, bucket, rest) and not divided within a node; the last node waits for the next batch."""
    held = None
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            rows = np.stack([batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("choice", "front", "bucket", "rest", "rep")])
            held = rows if held is None else np.concatenate([held, rows], axis=1)
        if held is None or not held.shape[1]:
            continue
        starts = np.flatnonzero(np.concatenate([[True], (held[:3, 1:] != held[:3, :-1]).any(axis=0)]))
        if batch is None:
            starts = np.append(starts, held.shape[1])
        done, held, starts = held[:, : starts[-1]], held[:, starts[-1] :], starts
        if len(starts) > 1:
            i, j = trie_pairs(done[3].astype(np.uint32), starts, done[2])
            if found := forest(done[4][i], done[4][j]):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])


def fingerprint_links(prints: DataFrame, split_at: int = SPLIT_AT) -> DataFrame:
    """Links (a, b) between rows (fp, rep) with distinct fp, that connect all whose fp differ in at most two bits."""
    block = lambda i: F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))
    two = lambda i, j: F.shiftleft(block(i), 16).bitwiseOR(block(j))
    choices = [F.struct(F.lit(n).cast("long").alias("choice"), two(i, j).alias("front"), two(*(set(range(4)) - {i, j})).alias("rest")) for n, (i, j) in enumerate(itertools.combinations(range(4), 2))]
    nodes = prints.select("rep", F.explode(F.array(*choices)).alias("x")).select("rep", "x.*")
    sizes = nodes.groupBy("choice", "front").count().where("count > 1")
    child = F.shiftrightunsigned("rest", 32 - SPLIT_BITS)
    masks = F.array(*(F.lit(m).cast("long") for m in range(1 << SPLIT_BITS) if m.bit_count() <= BUDGET))
    buckets = F.when(F.col("count") <= split_at, F.array(F.lit(-1).cast("long"))).otherwise(F.filter(F.transform(masks, lambda m: child.bitwiseXOR(m)), lambda c: c <= child))
    dealt = nodes.join(sizes, ["choice", "front"]).select("choice", "front", "rest", "rep", F.explode(buckets).alias("bucket"))
    return dealt.repartition("choice", "front", "bucket").sortWithinPartitions("choice", "front", "bucket", "rest").mapInArrow(_links, "a long, b long")


def candidate_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b), a < b: pairs of nodes (sig, fp) that connect all whose fingerprints differ in at most two bits; a star for each fingerprint, the trie's forest between these."""
    reps = stored(nodes.groupBy("fp").agg(F.min("sig").alias("rep")), "reps")
    copies = nodes.join(reps, "fp").where("sig != rep").select(F.col("sig").alias("x"), F.col("rep").alias("y"))
    found = fingerprint_links(reps).select(F.col("a").alias("x"), F.col("b").alias("y"))
    return copies.unionAll(found).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Texts are lower-cased in A-Z and cut to words at the bytes 0x20 and 0x09-0x0D; documents whose
    fingerprints differ in at most two bits are linked.  A null or empty text has fingerprint zero and is
    linked like any other; repeated rows are repeated in the result, as are rows without a doc_id, whose
    component has the smallest doc_id of those that have one, or null; an empty table gives an empty result.

    Links and components are of distinct fingerprints.  A fingerprint's component is sent to `salts` places, over
    which the documents that have it are dealt: the copies of one text are no single task's.
    """
    prints = stored(fingerprints(docs, id_col, text_col), "prints")
    reps = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("id")), "reps")
    found = connected_components(fingerprint_links(reps.select("fp", F.col("fp").alias("rep"))))
    classes = reps.join(found, reps["fp"] == found["node"], "left").select("fp", "id", F.coalesce("component", "fp").alias("component"))
    least = classes.groupBy("component").agg(F.min("id").alias("component_id"))
    salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    dealt = classes.join(least, "component").select("fp", "component_id", salt)
    own = prints.withColumn("salt", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(salts)).cast("int"))
    return own.join(dealt, ["fp", "salt"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
