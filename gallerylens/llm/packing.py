"""Best-fit packing by minimum bin slack.

Documents become pieces of at most 2048 tokens.  Packing needs only how many pieces have each length: the
table of counts has at most 2048 rows however large the corpus is, and goes to the driver.  There, for each
bin, a subset-sum over bitsets finds the fullest combination of the lengths left that holds the longest one;
the combination is removed as often as the counts allow.  That plan is broadcast, and each piece finds its
place by its rank among the pieces of its length.
"""

from __future__ import annotations

import os
import zlib
from array import array
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import batched, kept, stored, strings, texts
from .pieces import Remembered, in_groups

SIZE, END = 2048, 0


def encoder(path: str) -> Remembered:
    """One per worker and file, kept between tasks."""

    def build() -> Remembered:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        special = [t.content for t in made.get_added_tokens_decoder().values()]

        opens = np.zeros(made.get_vocab_size(), bool)  # ids of tokens that begin with a space, in the vocabulary's spelling of bytes
        opens[[i for t, i in made.get_vocab().items() if t[0] == "\u0120"]] = True

        def alone(new: list[str]) -> list[list[int]]:
            return [e.ids for e in made.encode_batch_fast(new, add_special_tokens=False)]

        def encode(new: list[str]) -> list[bytes]:
            # parts with one space, at their front, are encoded as one text: a token that begins with a space begins a part
            out: list[bytes | None] = [None] * len(new)
            easy = [i for i, p in enumerate(new) if p[:1] == " " and p.count(" ") == 1]
            if easy:
                ids = np.array(alone(["".join([new[i] for i in easy])])[0], "<u4")
                at = np.flatnonzero(opens[ids])
                if len(at) == len(easy):
                    whole, edges = ids.tobytes(), [*(4 * at).tolist(), 4 * len(ids)]
                    for i, a, b in zip(easy, edges, edges[1:], strict=False):
                        out[i] = whole[a:b]
            rest = [i for i, own in enumerate(out) if own is None]
            for i, own in zip(rest, alone([new[i] for i in rest]), strict=True):
                out[i] = array("I", own).tobytes()
            return out

        own = Remembered(encode)
        own.special = special
        own.whole = lambda text: array("I", made.encode(text, add_special_tokens=False).ids).tobytes()
        return own

    return kept(("packing", path), build)


def encoded(found: list[str], path: str) -> list[bytes]:
    """The ids of each text followed by the end id, as little-endian bytes."""
    own = encoder(path)
    end = array("I", [END]).tobytes()
    out = []
    for group in in_groups(found):
        for text, ids in zip(group, own.ids(group), strict=True):
            # a special token's string is cut out before the pattern is applied
            out.append((own.whole(text) if any(s in text for s in own.special) else ids) + end)
    return out


def pieces(docs: DataFrame, tokenizer: str, size: int = SIZE, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): only documents of more than size ids are cut; the first piece takes the remainder."""
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int64()))] * with_ids)

    def run(batches):
        def rows():
            for batch in batches:
                for doc, ids in zip(batch.column("doc_id").to_pylist(), encoded(strings(batch.column("text")), tokenizer), strict=True):
                    n = len(ids) // 4
                    edges = [0, *range((n - 1) % size + 1, n + 1, size)]
                    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                        part = ids[4 * a : 4 * b]
                        yield (doc, k, a, b - a, zlib.crc32(part)) + ((np.frombuffer(part, "<u4").astype(np.int64),) if with_ids else ())

        return batched(rows(), schema)

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids)


def fullest(counts: dict[int, int], size: int) -> list[tuple[int, int]]:
    """(length, how many) of the fullest combination that fits into size and holds the longest length.

    Bit s of a row tells that the lengths so far can add up to s.  The counts are taken in powers of two, so
    that each length costs as many shifts as its count has binary digits.
    """
    longest = max(counts)
    room = size - longest
    steps: list[tuple[int, int, int]] = []  # length, how many at once, reachable sums before
    sums, full = 1, (1 << room + 1) - 1
    for length in sorted((k for k in counts if 0 < k <= room), reverse=True):
        left, many = min(counts[length] - (length == longest), room // length), 1
        while left > 0 and not sums >> room & 1:
            take = min(many, left)
            steps.append((length, take, sums))
            sums |= sums << length * take & full
            left, many = left - take, 2 * many
        if sums >> room & 1:
            break
    at, chosen = sums.bit_length() - 1, {longest: 1}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + take
            at -= length * take
    return sorted(chosen.items(), reverse=True)


def plan(counts: dict[int, int], size: int = SIZE) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Places by (length, first rank, end rank, first sequence, how many in each sequence, offset there); the number of sequences."""
    left, used, places, sequences = {k: n for k, n in counts.items() if n > 0}, dict.fromkeys(counts, 0), [], 0
    while left:
        chosen = fullest(left, size)
        times = min(left[k] // n for k, n in chosen)
        offset = 0
        for k, n in chosen:
            places.append((k, used[k], used[k] + times * n, sequences, n, offset))
            used[k] += times * n
            left[k] -= times * n
            offset += k * n
            if not left[k]:
                del left[k]
        sequences += times
    return places, sequences


def pack(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """The rows of cut (doc_id, piece, length, ...) with sequence_id and offset; cut should be stored, it is read twice.

    Ranks within a length are dealt over many buckets of doc_id, so that a length that a third of all pieces
    share is no single task's; the buckets' counts give each its first rank.
    """
    n = max(64, int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(n)).cast("int"))
    counts = cut.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    first = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    first = stored(first.select("length", "bucket", "n", F.coalesce("before", F.lit(0)).alias("before")), "ranks")
    places, _ = plan({r[0]: r[1] for r in first.groupBy("length").agg(F.sum("n")).collect()}, size)  # at most size rows
    table: dict[int, tuple[list[int], list[tuple]]] = {}
    for k, *rest in places:
        starts, rows = table.setdefault(k, ([], []))
        starts.append(rest[0])
        rows.append(tuple(rest))
    shared = cut.sparkSession.sparkContext.broadcast(table)  # its size depends on the number of lengths alone
    # a merge join deals both sides out as the window needs them; the counts, 2048 rows a bucket, are not for broadcasting
    ranked = cut.join(first.drop("n").hint("merge"), ["length", "bucket"]).withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start")) - 1).drop("bucket", "before")

    def place(batches):
        for batch in batches:
            out = []
            for k, rank in zip(batch.column("length").to_pylist(), batch.column("rank").to_pylist(), strict=True):
                starts, rows = shared.value[k]
                low, _, sequence, many, offset = rows[bisect_right(starts, rank) - 1]
                out.append((sequence + (rank - low) // many, offset + (rank - low) % many * k))
            where = np.array(out, np.int64).reshape(-1, 2)
            kept = [i for i, name in enumerate(batch.schema.names) if name != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(where[:, 0]), pa.array(where[:, 1])], [*(batch.schema.names[i] for i in kept), "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    return ranked.mapInArrow(place, schema + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, size: int = SIZE, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset.

    A null or empty text is one piece of the end id alone; bytes that are not UTF-8 count as U+FFFD.  Rows that
    repeat, share a doc_id or have none are packed each for itself.  An empty table gives an empty result.
    """
    return pack(stored(pieces(docs, tokenizer, size, with_ids, id_col, text_col), "pieces"), size)
