"""Ranked lexical search over an index of clusters of like documents.

Recursive graph bisection puts documents that share terms next to each other: a set of documents is halved, and pairs
change sides as long as the cost of the postings, a term in d of n documents costing d log2(n / (d + 1)) bits, goes
down; then each half is halved.  It is done in two steps.  The first levels are fitted on a bounded sample
(SAMPLE documents, SAMPLE_TERMS terms of each); every document then goes down this tree by the terms it shares with
either side, which gives its shard.  A shard's documents meet in one task, in blocks of at most BLOCK_POSTINGS
postings, and each block is bisected in full, down to clusters of at most CLUSTER documents.  The sample decides only
where documents lie, never what is found.  A leaf that holds many documents, such as a third of all being copies, is
dealt out over as many shards as its share of the sample asks for.

A row of the index is a term of a block: its postings in the block's order, and its largest impact in each cluster.
A search adds up the impacts to a bound for each block, visits the best blocks first, and takes the k-th best score
found there as a threshold; all blocks whose bound reaches it are visited next, in each the clusters by falling bound,
until no bound reaches the k-th best.  So nothing that could be in the result, ties included, is left out.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import ROW, checkpoint_root, keyed, raw, release, stored, texts

SAMPLE, SAMPLE_TERMS, LEVELS = 1_024, 1_000, 5
BLOCK_POSTINGS, BLOCK_DOCS, CLUSTER, ROUNDS = 400_000, 16_384, 64, 4
#: Items that are sought at once, and blocks that are visited for each before there is a threshold.
ITEMS, FIRST = 256, 2
_TERM = bytes(c if chr(c).isalnum() and not 65 <= c <= 90 else c + 32 if 65 <= c <= 90 else 32 for c in range(128)) + bytes(range(128, 256))


def terms(text: bytes) -> list[bytes]:
    """Runs of digits, letters and bytes beyond ASCII; only A-Z become small."""
    return text.translate(_TERM).split()


def bisect(doc_of: np.ndarray, term_of: np.ndarray, n: int, leaf: int = CLUSTER, rounds: int = ROUNDS, levels: int | None = None) -> np.ndarray:
    """The leaf of each of n documents, given their distinct terms as pairs (document, term); leaves with near numbers are alike.

    All nodes of a level are halved at once.  Halves differ by one document at most.
    """
    node = np.zeros(n, np.int64)
    if levels is None:
        levels = max(0, math.ceil(math.log2(max(n, 1) / leaf)))
    often = np.bincount(term_of)[term_of] > 1 if len(term_of) else np.zeros(0, bool)  # other terms have no say
    doc_of, term_of = doc_of[often], term_of[often]
    logs = np.log2(np.arange(n + 3) + 1.0)
    n_terms = int(term_of.max()) + 1 if len(term_of) else 1
    for level in range(levels):
        order = np.argsort(node, kind="stable")
        sizes = np.bincount(node, minlength=1 << level)
        starts = np.cumsum(sizes) - sizes
        place = np.empty(n, np.int64)
        place[order] = np.arange(n) - starts[node[order]]
        side = (place >= (sizes[node] + 1) // 2).astype(np.int64)
        n_left, n_right = (sizes + 1) // 2, sizes // 2
        log_left, log_right = np.log2(np.maximum(n_left, 1)), np.log2(np.maximum(n_right, 1))
        _, inverse = np.unique(node[doc_of] * n_terms + term_of, return_inverse=True)
        node_of = np.zeros(int(inverse.max()) + 1 if len(inverse) else 0, np.int64)
        node_of[inverse] = node[doc_of]
        bits_left, bits_right = log_left[node_of], log_right[node_of]
        for _ in range(rounds):
            on = side[doc_of]
            degrees = np.bincount(inverse * 2 + on, minlength=2 * len(node_of)).reshape(-1, 2)
            left, right = degrees[:, 0], degrees[:, 1]
            cost = lambda d, bits: d * (bits - logs[d])
            now = cost(left, bits_left) + cost(right, bits_right)
            to_right = now - cost(np.maximum(left - 1, 0), bits_left) - cost(right + 1, bits_right)
            to_left = now - cost(left + 1, bits_left) - cost(np.maximum(right - 1, 0), bits_right)
            gain = np.bincount(doc_of, weights=np.where(on, to_left[inverse], to_right[inverse]), minlength=n)
            ranked = np.lexsort((-gain, node, side))
            lefts, rights = ranked[: n - side.sum()], ranked[n - side.sum() :]
            at_left, at_right = np.cumsum(n_left) - n_left, np.cumsum(n_right) - n_right
            partner = lefts[at_left[node[rights]] + np.arange(len(rights)) - at_right[node[rights]]]
            swap = gain[rights] + gain[partner] > 1e-9
            if not swap.any():
                break
            side[rights[swap]], side[partner[swap]] = 0, 1
        node = node * 2 + side
    return node


@dataclass
class Router:
    """The first levels: what each known term says for the right side at each node, and where each leaf's shards begin."""

    known: dict[bytes, int]
    says: np.ndarray
    levels: int
    first: np.ndarray
    shards: np.ndarray

    @classmethod
    def fit(cls, sample: list[list[bytes]], postings: int) -> Router:
        """From the terms of sampled documents and an estimate of all postings."""
        ids: dict[bytes, int] = {}
        doc_of = np.repeat(np.arange(len(sample)), [len(s) for s in sample])
        term_of = np.fromiter((ids.setdefault(t, len(ids)) for s in sample for t in s), np.int64)
        levels = max(0, min(LEVELS, int(math.log2(max(len(sample) / 16, 1)))))
        node = bisect(doc_of, term_of, len(sample), levels=levels)
        degrees = np.bincount(term_of, minlength=len(ids))
        often = np.flatnonzero(degrees > 1)
        place = np.full(len(ids), -1)
        place[often] = np.arange(len(often))
        says = np.zeros((len(often), (1 << levels) - 1), np.float32)
        for level in range(levels):
            for k in range(1 << level):
                under = (node[doc_of] >> (levels - level)) == k
                right = (node[doc_of] >> (levels - level - 1)) & 1 == 1
                d = [np.bincount(term_of[under & s], minlength=len(ids))[often] for s in (~right, right)]
                says[:, (1 << level) - 1 + k] = np.log2((d[1] + 0.5) / (d[0] + 0.5)) * (d[0] + d[1] > 0)
        share = np.bincount(node[doc_of], minlength=1 << levels) / max(len(doc_of), 1)
        shards = np.maximum(1, np.ceil(share * postings / BLOCK_POSTINGS)).astype(np.int64)
        return cls({t: int(place[i]) for t, i in ids.items() if place[i] >= 0}, says, levels, np.cumsum(shards) - shards, shards)

    def shard(self, own: list[bytes] | Counter, salt: int) -> int:
        some = [k for t in own if (k := self.known.get(t)) is not None]
        score = self.says[some].sum(axis=0) if some else np.zeros(self.says.shape[1])
        leaf = 0
        for level in range(self.levels):
            leaf = leaf * 2 + int(score[(1 << level) - 1 + leaf] > 0)
        return int(self.first[leaf]) + salt % int(self.shards[leaf])


@dataclass
class Index:
    path: str
    documents: int  # that have a term
    length: int  # terms of all, with repeats

    def rows(self, spark: SparkSession) -> DataFrame:
        """(block, term, df, most, clusters, impacts, docs, tfs); a block's own row has no term but doc_ids, ms and cluster_of."""
        return spark.read.schema(_ROWS).parquet(self.path)


_ROWS = "block long, term binary, df long, most long, clusters binary, impacts binary, docs binary, tfs binary, doc_ids array<long>, ms binary"
_IMPACT = np.int64(1_000_000_000)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return _IMPACT * tf // (1000 * tf + 8 * m)


def _binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Slices of data, from each offset to the next, as binary values."""
    edges = (offsets * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges.tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def _block(number: int, docs: list[tuple], documents: int, length: int) -> Iterator[pa.RecordBatch]:
    """The rows of a block of documents (doc_id, n, terms, tfs)."""
    ids: dict[bytes, int] = {}
    sizes = [len(d[2]) for d in docs]
    doc_of = np.repeat(np.arange(len(docs)), sizes)
    met = np.fromiter((ids.setdefault(t, len(ids)) for d in docs for t in d[2]), np.int64, sum(sizes))
    leaf = bisect(doc_of, met, len(docs))
    order = np.argsort(leaf, kind="stable")
    place = np.empty(len(docs), np.int64)
    place[order] = np.arange(len(docs))
    _, cluster_of = np.unique(leaf[order], return_inverse=True)
    names = sorted(ids)
    rank = np.empty(len(ids), np.int64)
    rank[[ids[t] for t in names]] = np.arange(len(ids))
    m = 25 + 75 * np.array([docs[i][1] for i in order], np.int64) * documents // length
    key = rank[met] * len(docs) + place[doc_of]
    by = np.argsort(key, kind="stable")
    term, doc = rank[met][by], place[doc_of][by]
    tf = np.concatenate([np.frombuffer(d[3], np.uint32) for d in docs])[by]
    edges = np.searchsorted(term, np.arange(len(names) + 1))
    cell = term * (int(cluster_of.max()) + 1) + cluster_of[doc]
    starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    most = np.maximum.reduceat(impact(tf.astype(np.int64), m[doc]), starts)
    cell_edges = np.searchsorted(starts, edges)
    n, empty = len(names), pa.nulls(len(names), pa.binary())
    schema = pa.schema([("block", pa.int64()), ("term", pa.binary()), ("df", pa.int64()), ("most", pa.int64()), *((c, pa.binary()) for c in ("clusters", "impacts", "docs", "tfs")), ("doc_ids", pa.list_(pa.int64())), ("ms", pa.binary())])
    own = [pa.array([v], t) for v, t in zip([number, b"", 0, 0, cluster_of.astype(np.uint16).tobytes(), b"", b"", b"", [docs[i][0] for i in order], m.tobytes()], schema.types, strict=True)]
    yield pa.RecordBatch.from_arrays(own, schema=schema)
    columns = [
        pa.array(np.full(n, number)), pa.array(names, pa.binary()), pa.array(np.diff(edges)), pa.array(np.maximum.reduceat(most, cell_edges[:-1])), _binary(cluster_of[doc[starts]].astype(np.uint16), cell_edges),
        _binary(most.astype(np.uint32), cell_edges), _binary(doc.astype(np.uint16), edges), _binary(tf, edges), pa.nulls(n, pa.list_(pa.int64())), empty,
    ]
    made = pa.RecordBatch.from_arrays(columns, schema=schema)
    for at in range(0, n, 8192):
        yield made.slice(at, 8192)


def build(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The index of docs, at path.

    Rows with a null or empty text, or without a term, are in no index and count nowhere; repeated rows, and rows
    without an id, are documents of their own; very long texts are taken whole (a block ends once it is full).  An
    empty table gives an index without rows.
    """
    rows = keyed(docs)
    every = max(1, rows.count() // SAMPLE)
    salted = texts(rows, id_col, text_col, [F.pmod(F.xxhash64(*ROW), F.lit(1 << 30)).alias("salt")])

    def measure(batches):
        for batch in batches:
            n, length, postings, sample = 0, 0, 0, []
            for text, salt in zip(raw(batch.column("text")), batch.column("salt").to_pylist(), strict=True):
                own = terms(text)
                n, length = n + bool(own), length + len(own)
                if salt % every == 0 and own:
                    distinct = set(own)
                    postings += len(distinct)
                    sample.append(b" ".join(sorted(distinct, key=lambda t: (zlib.crc32(t), t))[:SAMPLE_TERMS]))
            columns = [[n, *[0] * len(sample)], [length, *[0] * len(sample)], [postings, *[0] * len(sample)], [None, *sample]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.binary()], strict=True)], ["n", "length", "postings", "sample"])

    measured = stored(salted.mapInArrow(measure, "n long, length long, postings long, sample binary"), "measured")
    n, length, postings = (int(x or 0) for x in measured.agg(F.sum("n"), F.sum("length"), F.sum("postings")).first())
    sample = [bytes(r[0]).split(b" ") for r in measured.where("sample IS NOT NULL").orderBy("sample").limit(2 * SAMPLE).select("sample").collect()]  # bounded
    router = Router.fit(sample, postings * every)
    shared = docs.sparkSession.sparkContext.broadcast(router)  # SAMPLE times SAMPLE_TERMS terms at most

    def route(batches):
        router = shared.value
        for batch in batches:
            ids, out = batch.column("doc_id").to_pylist(), []
            for doc, text, salt in zip(ids, raw(batch.column("text")), batch.column("salt").to_pylist(), strict=True):
                own = Counter(terms(text))
                if own:
                    out.append((router.shard(own, salt), salt, doc, sum(own.values()), b" ".join(own), np.fromiter(own.values(), np.uint32, len(own)).tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64()] * 4 + [pa.binary()] * 2, strict=True)], ["shard", "salt", "doc_id", "n", "terms", "tfs"])
        release()

    def index(batches):
        task, count = TaskContext.get().partitionId(), 0
        held, size = [], 0
        for batch in batches:
            for doc, n, own, tfs in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "terms", "tfs")), strict=True):
                if held and (size + len(tfs) // 4 > BLOCK_POSTINGS or len(held) == BLOCK_DOCS):
                    yield from _block(task << 32 | count, held, n_docs, length)
                    held, size, count = [], 0, count + 1
                    release()
                held.append((doc, n, own.split(b" "), tfs))
                size += len(tfs) // 4
        if held:
            yield from _block(task << 32 | count, held, n_docs, length)
        held.clear()
        release()

    n_docs = n
    dealt = salted.mapInArrow(route, "shard long, salt long, doc_id long, n long, terms binary, tfs binary").repartition(int(router.shards.sum()), "shard")
    dealt.sortWithinPartitions("shard", "salt").mapInArrow(index, _ROWS).write.mode("overwrite").parquet(path)
    return Index(path, n, length)


def _visit(rows: pa.Table, wanted: list[tuple[int, int]], asked: list[list[tuple[bytes, int]]], k: int) -> Iterator[tuple]:
    """(item, doc_id, score): the best k documents of a block for each item whose score reaches its threshold."""
    at = {t: i for i, t in enumerate(rows.column("term").to_pylist())}
    own = at.pop(b"")
    value = lambda c, i, t: np.frombuffer(rows.column(c)[i].as_buffer(), t)
    cluster_of, m = value("clusters", own, np.uint16), value("ms", own, np.int64)
    ids = rows.column("doc_ids")[own].as_py()
    order = np.array([(1 << 63) - 1 if i is None else i for i in ids], np.int64)  # a null id comes last
    n_clusters = int(cluster_of.max()) + 1
    held: dict[bytes, tuple] = {}

    def term(t: bytes) -> tuple:
        if t not in held:
            i = at[t]
            docs = value("docs", i, np.uint16)
            held[t] = value("clusters", i, np.uint16), value("impacts", i, np.uint32).astype(np.int64), docs, impact(value("tfs", i, np.uint32).astype(np.int64), m[docs])
        return held[t]

    for item, least in wanted:
        mine = [(term(t), w) for t, w in asked[item] if t in at and w]
        bound = np.zeros(n_clusters, np.int64)
        for (clusters, most, _, _), w in mine:
            bound[clusters] += w * most
        by = np.argsort(-bound, kind="stable")
        by = by[bound[by] >= max(least, 1)]
        if not len(by):
            continue
        docs = np.concatenate([x[2] for x, _ in mine])
        adds = np.concatenate([w * x[3] for x, w in mine])
        cluster = cluster_of[docs]
        best, limit, done, step = np.zeros((0, 2), np.int64), max(least, 1), 0, 4
        while done < len(by) and bound[by[done]] >= limit:
            now = by[done : done + step]
            done, step = done + step, step * 2
            open_ = np.zeros(n_clusters, bool)
            open_[now] = True
            some = open_[cluster]
            score = np.bincount(docs[some], weights=adds[some], minlength=len(m)).astype(np.int64)  # sums stay far below 2^53
            found = np.flatnonzero(score >= limit)
            best = np.concatenate([best, np.stack([score[found], found], axis=1)])
            best = best[np.lexsort((order[best[:, 1]], -best[:, 0]))[:k]]
            if len(best) == k:
                limit = max(limit, int(best[-1, 0]))
        for s, d in best.tolist():
            yield item, ids[d], s


def _blocks_of(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple]]:
    """At most ITEMS items (id, Counter of terms) at once; the query set streams through the driver."""
    held = []
    for r in items.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).cast("binary")).toLocalIterator():
        held.append((r[0], Counter(terms(bytes(r[1])))))
        if len(held) == ITEMS:
            yield held
            held = []
    if held:
        yield held


def search(index: Index, items: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of items the k documents of the highest score above 0, equal ones by doc_id, null last.

    A term's weight is floor(1000 ln((2N + 2) / (2 df + 1))), all else is in whole numbers; a term that an item repeats
    counts as often.  Items without a term that any document has find nothing.
    """
    spark, out = items.sparkSession, None
    kind = items.schema[id_col].dataType
    for block in _blocks_of(items, id_col, text_col):
        found = _search(spark, index, [c for _, c in block], k)
        names = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(block)], f"item long, item_id {kind.simpleString()}")
        best = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        top = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = top if out is None else out.unionAll(top)
    return spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long") if out is None else out


def _search(spark: SparkSession, index: Index, items: list[Counter], k: int) -> DataFrame:
    """(item, doc_id, score) that hold the k best of each item."""
    sought = spark.createDataFrame([(bytearray(t),) for t in sorted(set().union(b"", *items))], "term binary")
    rows = index.rows(spark)
    mine = rows.join(F.broadcast(sought), "term", "left_semi")  # the terms of ITEMS items
    df = {bytes(r[0]): r[1] for r in mine.groupBy("term").agg(F.sum("df")).collect()}
    weight = {t: math.floor(1000 * math.log((2 * index.documents + 2) / (2 * n + 1))) for t, n in df.items()}
    asked = [[(t, n * weight[t]) for t, n in own.items() if t in weight] for own in items]
    shared = spark.sparkContext.broadcast(asked)
    weights = spark.createDataFrame([(i, bytearray(t), w) for i, own in enumerate(asked) for t, w in own if w], "item long, term binary, w long")
    bounds = stored(rows.select("block", "term", "most").join(F.broadcast(weights), "term").groupBy("item", "block").agg(F.sum(F.col("w") * F.col("most")).alias("bound")), "bounds")
    needed = rows.join(F.broadcast(sought.unionAll(spark.createDataFrame([(bytearray(),)], "term binary"))), "term", "left_semi")

    def visit(pairs: DataFrame) -> DataFrame:
        def run(key, left, right):
            wanted = [*zip(right.column("item").to_pylist(), right.column("least").to_pylist(), strict=True)]
            if not wanted or not left.num_rows:
                return pa.table([pa.array([], pa.int64())] * 3, ["item", "doc_id", "score"])
            made = [*_visit(left, wanted, shared.value, k)]
            return pa.table([pa.array(c, pa.int64()) for c in (zip(*made, strict=True) if made else [()] * 3)], ["item", "doc_id", "score"])

        own = needed.join(pairs.select("block").distinct(), "block", "left_semi").select("block", "term", "clusters", "impacts", "docs", "tfs", "doc_ids", "ms")
        return stored(own.groupBy("block").cogroup(pairs.groupBy("block")).applyInArrow(run, "item long, doc_id long, score long"), "visited")

    order = Window.partitionBy("item").orderBy(F.col("bound").desc(), "block")
    first = stored(bounds.withColumn("r", F.row_number().over(order)).where(F.col("r") <= FIRST).select("item", "block", F.lit(1).cast("long").alias("least")), "first")
    some = visit(first)
    kth = some.withColumn("r", F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc()))).where(F.col("r") == k).select("item", F.col("score").alias("least"))
    rest = bounds.join(first, ["item", "block"], "left_anti").join(F.broadcast(kth), "item", "left").select("item", "block", "bound", F.coalesce("least", F.lit(1)).alias("least"))
    return some.unionAll(visit(stored(rest.where(F.col("bound") >= F.col("least")).drop("bound"), "rest")))


def ranked(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """search over an index of docs that is built in the shared folder."""
    path = f"{checkpoint_root(docs.sparkSession)}/lexical-{docs.sparkSession.sparkContext.applicationId}-{id(docs):x}"
    return search(build(docs, path), items, k)
