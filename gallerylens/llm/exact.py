"""Exact deduplication by Grace hashing.

Texts are equal when identical after deleting the bytes 0x20 and 0x09-0x0D.  Each task partitions its
records to spill files, recursively, until a bucket's distinct contents fit its memory budget; an
open-addressing table then compares complete contents.  The first pass runs on the input partitions, so a
group of copies leaves each of them as one record; only those records are shuffled, and a second Grace pass
merges them.  A hot group therefore costs one record per input partition, and no class is ever gathered.

Spill files belong to one task, as Spark's own spill files do: a lost executor's tasks write them anew.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import WHITE, batched, kept, raw, rows_of, stored, texts

FANOUT_BITS = 4
LEVELS = 64 // FANOUT_BITS


class OpenTable:
    """Contents by open addressing with linear probing; equal means all bytes equal, never the hash alone."""

    def __init__(self) -> None:
        self.slots, self.hashes, self.contents = [-1] * 1024, [], []

    def place(self, h: int, content: bytes) -> tuple[int, bool]:
        """The entry that holds content, and whether it is new."""
        slots, mask = self.slots, len(self.slots) - 1
        at = h & mask
        while (k := slots[at]) >= 0:
            if self.hashes[k] == h and self.contents[k] == content:
                return k, False
            at = (at + 1) & mask
        slots[at] = k = len(self.contents)
        self.hashes.append(h)
        self.contents.append(content)
        if 3 * len(self.contents) > 2 * len(slots):
            self._grow()
        return k, True

    def _grow(self) -> None:
        self.slots = slots = [-1] * (2 * len(self.slots))
        mask = len(slots) - 1
        for k, h in enumerate(self.hashes):
            at = h & mask
            while slots[at] >= 0:
                at = (at + 1) & mask
            slots[at] = k


def grace_classes(rows: Iterable[tuple[bytes, tuple]], budget: int, level: int = 0) -> Iterator[tuple[bytes, list[tuple]]]:
    """(content, members) of each class among rows of (content, member).

    Past budget bytes of distinct contents, the table and the remaining rows are dealt to spill files by the
    next bits of the hash, and each file is treated alike.
    """
    table, members, held = OpenTable(), [], 0
    rows = iter(rows)
    for content, member in rows:
        k, new = table.place(xxhash.xxh3_64_intdigest(content), content)
        if not new:
            members[k].append(member)
            continue
        members.append([member])
        held += len(content) + 200
        if held > budget and len(members) > 1 and level < LEVELS:
            break
    else:
        yield from zip(table.contents, members, strict=True)
        return
    mask, shift = (1 << FANOUT_BITS) - 1, level * FANOUT_BITS
    with tempfile.TemporaryDirectory(prefix="grace-") as folder:
        files = [open(f"{folder}/{i}", "w+b") for i in range(mask + 1)]
        try:
            for content, own in zip(table.contents, members, strict=True):
                pickle.dump((content, own), files[xxhash.xxh3_64_intdigest(content) >> shift & mask], 5)
            del table, members
            for content, member in rows:
                pickle.dump((content, [member]), files[xxhash.xxh3_64_intdigest(content) >> shift & mask], 5)
            for file in files:
                yield from grace_classes(_spilled(file), budget, level + 1)
        finally:
            for file in files:
                file.close()


def _spilled(file) -> Iterator[tuple[bytes, tuple]]:
    file.seek(0)
    while True:
        try:
            content, own = pickle.load(file)
        except EOFError:
            return
        for member in own:
            yield content, member


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 64 << 20, carry: Sequence[str] = ()) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, and the columns of carry (longs), which may name the row.

    Of equal texts the row with the most code points in the original text stays, then the smallest doc_id; a null
    doc_id is larger than all others, and null as keep_id.  A null text counts as empty; all texts of white space
    only are equal.  Repeated rows with one doc_id are separate rows of the result, of which one at most is kept.
    An empty table gives an empty result.
    """
    more = [(c, pa.int64()) for c in carry]
    local = pa.schema([("doc_id", pa.int64()), ("uid", pa.int64()), ("rep", pa.int64()), ("chars", pa.int64()), ("best_id", pa.int64()), ("best_uid", pa.int64()), ("n", pa.int64()), ("content", pa.binary()), *more])
    merged = pa.schema([("rep", pa.int64()), ("keep_id", pa.int64()), ("keep_uid", pa.int64()), ("group_size", pa.int64()), ("text_sha256", pa.string())])
    order = lambda chars, doc: (-chars, doc is None, doc or 0)

    def normalised(batches, first: int) -> Iterator[tuple[bytes, tuple]]:
        uid = first
        for batch in batches:
            for doc, text, *own in zip(batch.column("doc_id").to_pylist(), raw(batch.column("text")), *(batch.column(c).to_pylist() for c in carry), strict=True):
                yield text.translate(None, WHITE), (*order(len(text.decode("utf-8", "replace")), doc), uid, doc, *own)
                uid += 1

    def in_partition(batches):
        kept(("exact",), lambda: None)  # another operator's tables go

        def rows():
            for content, own in grace_classes(normalised(batches, TaskContext.get().partitionId() << 36), budget):
                chars, _, _, best_uid, best, *_ = min(own)
                rep = own[0][3]
                for _, _, _, uid, doc, *rest in own:
                    yield (doc, uid, rep, -chars, best, best_uid, len(own), content, *rest) if uid == rep else (doc, uid, rep, None, None, None, None, None, *rest)

        return batched(rows(), local, 1024)

    def across(batches):
        def rows():
            found = rows_of(batches, "content", "chars", "best_id", "best_uid", "rep", "n")
            for content, own in grace_classes(((c, (*order(chars, best), uid, best, rep, n)) for c, chars, best, uid, rep, n in found), budget):
                _, _, _, keep_uid, keep, _, _ = min(own)
                total, sha = sum(x[6] for x in own), hashlib.sha256(content).hexdigest()
                for x in own:
                    yield x[5], keep, keep_uid, total, sha

        return batched(rows(), merged)

    schema = "doc_id long, uid long, rep long, chars long, best_id long, best_uid long, n long, content binary" + "".join(f", {c} long" for c in carry)
    seen = stored(texts(docs, id_col, text_col, carry).mapInArrow(in_partition, schema), "exact")
    reps = seen.where("content is not null").select("content", "chars", "best_id", "best_uid", "rep", "n").repartition(F.xxhash64("content"))
    classes = reps.mapInArrow(across, "rep long, keep_id long, keep_uid long, group_size long, text_sha256 string")
    return seen.select("doc_id", "uid", "rep", *carry).join(classes, "rep").select("doc_id", "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"), "text_sha256", *carry)
