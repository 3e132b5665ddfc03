"""Near-duplicates by an exact similarity join of word shingles.

A document is the set of its shingles, told apart by 64-bit hashes and put in one order for all documents: those
common in a sample of the documents last, by how common they are, and the others by their hashes.  Any order would
do; this one keeps shingles of many documents from being the ones under which they meet.  Two sets of n and m with a Jaccard similarity of t or more share a shingle among the first n - ceil(t n) + 1 of the one and
the first m - ceil(t m) + 1 of the other, so that only documents that meet under such a shingle, and whose sizes
and places there leave room for enough in common, are compared, shingle by shingle.  No pair is missed, which
fingerprints cannot promise: at 0.8 two of 64 bits differ by about 10 bits, and by 18 now and then.

Before whole sets are compared, sketches are: of SKETCH bits, each the parity of how many shingles fall to it.  As
many bits as two sketches differ in, so many shingles at least are in one set alone, so that most pairs that share a
passage and no more are told apart by 128 bytes each, and no similar pair is.

Equal sets are one node.  Nodes whose SimHash fingerprints of 64 bits differ in two at most meet first, by the trie of
`simhash`, and their pairs are held against the whole sets.  What fingerprints cannot promise follows: under a shingle, nodes first meet their neighbours by size alone: under the
first shingle in each of ORDERS, most of which similar sets share, so that most of a large group is connected by a few
pairs a node, and then under all shingles of prefixes, where they belong to different components.  What that connects is not compared again, and then all that still belong to
different components meet, those of like size first.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import discard, kept, raw, stored, texts, written
from .components import connected_components
from .simhash import bits_of, candidate_pairs

SHINGLE, SIMILARITY, SEED, PAIRS, SKETCH = 5, 0.8, 42, 1 << 18, 1024
#: Odd numbers, each of which puts the shingles in an order of its own.
ORDERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x94D049BB133111EB, 0xBF58476D1CE4E5B9)]
#: How far apart by size the nodes of one shingle are that meet in one round.
REACHES = [32]
#: Ids and nodes of so many rows at most are broadcast; they are counted first.
BROADCAST_ROWS = 200_000
#: These decide the order of shingles alone, never which pairs are found.
SAMPLE_ROWS, COMMON, COMMON_ROWS = 20_000, 4, 200_000


def shingle_set(text: bytes, words: int = SHINGLE) -> np.ndarray:
    """The sorted hashes of a text's shingles; fewer words than a shingle has: all of them at once."""
    found = text.lower().split()
    shingles = zip(*(found[i:] for i in range(words)), strict=False) if len(found) >= words else [found]
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return np.unique(np.fromiter((digest(join(s), SEED) for s in shingles), np.uint64, max(1, len(found) - words + 1)))


def _signature(found: np.ndarray) -> int:
    """Names a set, as a signed long."""
    return xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63)


def sketch(found: np.ndarray) -> bytes:
    """A bit for each part of the hashes' range: whether an odd number of shingles falls there."""
    return np.packbits(np.bincount((found >> np.uint64(54)).astype(np.int64), minlength=SKETCH).astype(np.uint8) & 1).tobytes()


def firsts(found: np.ndarray) -> np.ndarray:
    """The first shingle in each of ORDERS: similar sets share most of them."""
    out = np.empty(len(ORDERS), np.uint64)
    for k, odd in enumerate(ORDERS):
        x = (found ^ (found >> np.uint64(31))) * odd
        out[k] = ((x ^ (x >> np.uint64(29))) * ORDERS[0]).min() ^ odd
    return out


def _enough(same: np.ndarray, n: np.ndarray, m: np.ndarray, least: Fraction) -> np.ndarray:
    """Whether so many shingles in common make sets of n and m similar."""
    return same * (least.numerator + least.denominator) >= least.numerator * (n + m)


def _counts(batches, words: int):
    for batch in batches:
        keys, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *(shingle_set(t, words) for t in raw(batch.column("text")))]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["key", "n"])


def common_shingles(rows: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of the shingles of several documents of a sample, by hash; at most COMMON_ROWS."""
    part = max(1, rows.count() // SAMPLE_ROWS)
    some = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(part)) == 0).select("text")
    found = some.mapInArrow(lambda it: _counts(it, words), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON)
    found = found.orderBy(F.desc("n"), "key").limit(COMMON_ROWS).toPandas()
    keys, n = found["key"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy(np.int64)
    order = np.argsort(keys)
    return keys[order], n[order]


def _ordered(found: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    if not len(keys):
        return found
    at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
    return found[np.argsort(np.where(keys[at] == found, counts[at], 0), kind="stable")]


def _prefixes(batches, words: int, least: Fraction, common, carry):
    kept(("shingles",), lambda: None)  # another operator's tables go
    for batch in batches:
        sigs, sizes, ahead, sketches, meets, prints = [], [], [], [], [], []
        for text in raw(batch.column("text")):
            found = shingle_set(text, words)
            n = len(found)
            sigs.append(_signature(found))
            sizes.append(n)
            sketches.append(sketch(found))
            prints.append(bits_of(found))
            meets.append(firsts(found).view(np.int64))
            ahead.append(_ordered(found, *common.value)[: n + 1 + -n * least.numerator // least.denominator].view(np.int64))
        lists = lambda xs: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, xs)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *xs])))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sigs, pa.int64()), pa.array(sizes, pa.int64()), lists(ahead), pa.array(sketches, pa.binary()), lists(meets), pa.array(np.array(prints, np.uint64).view(np.int64)), *(batch.column(c) for c in carry)], ["doc_id", "sig", "n", "prefix", "sketch", "firsts", "fp", *carry])


def _whole_groups(batches, *names: str):
    """Columns of whole groups of one key, from rows sorted by key; each (key, sig) once."""
    held = None
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names])
            held = rows if held is None else np.concatenate([held, rows], axis=1)
        if held is None or not held.shape[1]:
            continue
        end = held.shape[1] if batch is None else int(np.searchsorted(held[0], held[0, -1]))
        done, held = held[:, :end], held[:, end:]
        if end:
            yield done[:, np.concatenate([[True], (done[:2, 1:] != done[:2, :-1]).any(axis=0)])]


def _meet(rows: np.ndarray, i: np.ndarray, j: np.ndarray, least: Fraction) -> np.ndarray:
    """Whether the sizes and places of two rows (key, sig, n, pos) of a key leave room for enough in common."""
    n, m = rows[2, i], rows[2, j]
    return _enough(np.minimum(n - rows[3, i], m - rows[3, j]), n, m, least)


def _out(kind: int, rows: np.ndarray):
    for k in range(0, rows.shape[1], 100_000):
        part = rows[:, k : k + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(part.shape[1], kind, np.int64)), *(pa.array(c) for c in part)], ["kind", "key", "a", "b", "pos"])


def _neighbours(batches, least: Fraction):
    """Kind 0: pairs (a, b) of neighbours by size of different components; kind 1: a row for each key of three or more in several components."""
    for rows in _whole_groups(batches, "key", "sig", "n", "pos", "component"):
        i = np.flatnonzero((rows[0, 1:] == rows[0, :-1]) & (rows[4, 1:] != rows[4, :-1]))
        i = i[_meet(rows, i, i + 1, least)]
        yield from _out(0, _pair_rows([np.sort(np.stack([rows[1, i], rows[1, i + 1]]), axis=0)]))
        at = np.flatnonzero(np.concatenate([[True], rows[0, 1:] != rows[0, :-1]]))
        size = np.diff(np.append(at, rows.shape[1]))
        several = np.minimum.reduceat(rows[4], at) != np.maximum.reduceat(rows[4], at)
        yield from _out(1, rows[:4, at[(size > 2) & several]])


def _others(batches, least: Fraction, low: int, high: int | None):
    """Pairs of nodes of one key and different components that lie low to high (not included) places apart by size."""
    held, size = [], 0
    for rows in _whole_groups(batches, "key", "sig", "n", "pos", "component"):
        at = np.flatnonzero(np.concatenate([[True], rows[0, 1:] != rows[0, :-1]]))
        several = np.minimum.reduceat(rows[4], at) != np.maximum.reduceat(rows[4], at)
        rows = rows[:, np.repeat(several, np.diff(np.append(at, rows.shape[1])))]
        i, step = np.arange(rows.shape[1]), low
        while len(i := i[i + step < rows.shape[1]]) and (high is None or step < high):
            # sizes grow along a group: a row too large for i leaves no room for any after it
            i = i[(rows[0, i] == rows[0, i + step]) & (least.denominator * rows[2, i] >= least.numerator * rows[2, i + step])]
            met = i[(rows[4, i] != rows[4, i + step]) & _meet(rows, i, i + step, least)]
            if len(met):
                held.append(np.sort(np.stack([rows[1, met], rows[1, met + step]]), axis=0))
                size += len(met)
            if size >= PAIRS:
                yield from _out(0, _pair_rows(held))
                held, size = [], 0
            step += 1
    if held:
        yield from _out(0, _pair_rows(held))


def _pair_rows(held: list[np.ndarray]) -> np.ndarray:
    pairs = np.unique(np.concatenate(held, axis=1), axis=1)
    return np.stack([np.zeros_like(pairs[0]), *pairs, np.zeros_like(pairs[0])])


def _near(batches, least: Fraction):
    """The pairs whose sketches, left and right, leave room for enough in common."""
    for batch in batches:
        if not batch.num_rows:
            continue
        left, right = (np.frombuffer(b"".join(raw(batch.column(c))), np.uint64).reshape(batch.num_rows, -1) for c in ("left", "right"))
        alone = np.bitwise_count(left ^ right).sum(axis=1, dtype=np.int64)
        total = sum(batch.column(c).to_numpy(zero_copy_only=False) for c in ("n", "m"))
        use = alone * (least.denominator + least.numerator) <= total * (least.denominator - least.numerator)
        yield batch.select(["a", "b"]).filter(pa.array(use))


def _similar(batches, least: Fraction):
    for batch in batches:
        a, b = [], []
        for x, y, left, right in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "left", "right")), strict=True):
            left, right = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
            if _enough(len(np.intersect1d(left, right, assume_unique=True)), len(left), len(right), least):
                a.append(x)
                b.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _sets(batches, words: int):
    for batch in batches:
        found = [shingle_set(t, words) for t in raw(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([pa.array([_signature(f) for f in found], pa.int64()), pa.array([f.tobytes() for f in found], pa.binary())], ["sig", "found"])


def similar_documents(docs: DataFrame, words: int = SHINGLE, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """One row per document: doc_id, component_id (smallest doc_id reachable by pairs of that Jaccard similarity or more), kept, carry.

    One row of each component is kept: of the smallest doc_id, a null one being the largest, then of the smallest
    values of carry, longs that may name the row.  Without carry, rows that repeat a kept doc_id are kept too.

    Texts are lower-cased in A-Z and cut to words at the bytes 0x20 and 0x09-0x0D; a text of fewer words than a
    shingle has is one shingle.  Null and empty texts are equal to each other alone; repeated rows are repeated
    in the result; an empty table gives an empty result.
    """
    least = Fraction(similarity).limit_denominator(1000)
    rows = texts(docs, id_col, text_col, carry)
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(rows, words))  # its size is bounded
    prints = stored(rows.mapInArrow(lambda it: _prefixes(it, words, least, common, carry), "doc_id long, sig long, n long, prefix array<long>, sketch binary, firsts array<long>, fp long" + "".join(f", {c} long" for c in carry)), "prefixes")
    drawn = "kind long, key long, a long, b long, pos long"

    def few(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df

    def both(pairs: DataFrame, of: DataFrame, *names: tuple[str, str, str]) -> DataFrame:
        """pairs with columns of the nodes a and b: (column, its name for a, its name for b)."""
        left, right = ([F.col("sig").alias(end), *(F.col(n[0]).alias(n[k]) for n in names)] for k, end in ((1, "a"), (2, "b")))
        return pairs.join(of.select(*left), "a").join(of.select(*right), "b")

    def links(pairs: DataFrame) -> DataFrame:
        """The similar ones of pairs; the tables on the way to them go."""
        mark = written()
        out = compared(pairs)
        discard(out.sparkSession, mark)
        return out

    def compared(pairs: DataFrame) -> DataFrame:
        pairs = stored(pairs.distinct(), "pairs")
        ends = pairs.select(F.col("a").alias("sig")).unionAll(pairs.select("b")).distinct()
        marks = stored(prints.join(ends, "sig", "left_semi").groupBy("sig").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")), "sketches")
        pairs = stored(both(pairs, marks, ("sketch", "left", "right"), ("n", "n", "m")).select("a", "b", "left", "right", "n", "m").mapInArrow(lambda it: _near(it, least), "a long, b long"), "near")
        if pairs.isEmpty():
            return pairs  # no text has to be read
        nodes = stored(pairs.select(F.col("a").alias("sig")).unionAll(pairs.select("b")).distinct(), "nodes")
        ids = stored(prints.join(few(nodes), "sig", "left_semi").select("doc_id").distinct(), "ids")
        some = rows.join(few(ids), "doc_id", "left_semi").select("text").unionAll(rows.where("doc_id is null").select("text"))
        found = some.mapInArrow(lambda it: _sets(it, words), "sig long, found binary")
        found = stored(found.join(few(nodes), "sig", "left_semi").dropDuplicates(["sig"]), "sets")
        whole = both(pairs, found, ("found", "left", "right")).select("a", "b", "left", "right")
        return stored(whole.mapInArrow(lambda it: _similar(it, least), "a long, b long"), "similar")

    def keys(df: DataFrame, of: str) -> DataFrame:
        """A row a key; in an order of its own no place says anything."""
        pos = F.col("pos").cast("long") if of == "prefix" else F.lit(0).cast("long")
        return df.select("sig", "n", "component", F.posexplode(of).alias("pos", "key")).select("key", "sig", "n", pos.alias("pos"), "component")

    def met(rows: DataFrame, how) -> DataFrame:
        return rows.repartition("key").sortWithinPartitions("key", "n", "sig").mapInArrow(lambda it: how(it, least), drawn)

    def placed(df: DataFrame, found: DataFrame) -> DataFrame:
        """df with the component of its sig, which is the sig itself if nothing is known."""
        return df.join(few(found.withColumnRenamed("node", "sig")), "sig", "left").withColumn("component", F.coalesce("component", "sig"))

    # fingerprints first, by the trie; what they propose is held against the whole sets
    near = links(candidate_pairs(prints.select("sig", "fp").distinct()))
    found = stored(connected_components(near), "components")
    # neighbours under the first shingles of several orders connect most of a large group by few pairs
    near = near.unionAll(links(met(keys(placed(prints.select("sig", "n", "firsts"), found), "firsts"), _neighbours).where("kind = 0").select("a", "b")))
    found = stored(connected_components(near), "components")
    # then neighbours under all that are not connected yet
    second = stored(met(keys(placed(prints.select("sig", "n", "prefix"), found), "prefix"), _neighbours), "neighbours")
    near = near.unionAll(links(second.where("kind = 0").select("a", "b")))
    found = stored(connected_components(near), "components")
    # and then the others of different components, nearer ones first: what connects two groups spares most of their pairs
    several = few(stored(second.where("kind = 1").select("key").distinct(), "several"))
    others = stored(keys(prints.select("sig", "n", "prefix", F.col("sig").alias("component")), "prefix").drop("component").join(several, "key", "left_semi"), "several-rows")
    for low, high in itertools.pairwise([2, *REACHES, None]):
        rest = stored(met(placed(others, found), lambda it, least, low=low, high=high: _others(it, least, low, high)).select("a", "b"), "others")
        if not rest.isEmpty():
            near = near.unionAll(links(rest))
            found = stored(connected_components(near), "components")
    classes = prints.select("doc_id", "sig", *carry).join(found.withColumnRenamed("node", "sig"), "sig", "left").select("doc_id", *carry, F.coalesce("component", "sig").alias("component"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *carry)
    return classes.join(classes.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.min(order).alias("first")), "component").select("doc_id", "component_id", (order == F.col("first")).alias("kept"), *carry)
