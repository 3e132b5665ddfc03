"""Nearest vectors, late interaction and retrieval metrics.

Queries are a bounded set: they are shipped to the corpus in blocks, and each task keeps its best k a query, so
that what is shuffled is k rows a query and task however large the corpus is.
"""

from __future__ import annotations

import time

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import vector as V
from .ranks import small
from .scratch import stored

BLOCK_VALUES = 4 << 20  # doubles of queries that are broadcast at once
TILE = 1024  # rows of queries, and of a corpus, that are scored at once: what a task holds does not grow with either
SLACK = 1e-9  # products so near to the best are computed again
POOLED_VALUES = 1 << 17  # values of the documents whose vectors are pooled, or scored pair by pair, at once


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _blocks(queries: DataFrame, id_col: str, vec_col: str):
    """Query rows as (ids, matrix), each block of at most BLOCK_VALUES values; the query set streams through the driver."""
    ids, vectors, size = [], [], 0
    for r in queries.select(id_col, vec_col).toLocalIterator():
        if vectors and size + len(r[1]) > BLOCK_VALUES:
            yield ids, np.array(vectors, np.float64)
            ids, vectors, size = [], [], 0
        ids.append(r[0])
        vectors.append(r[1])
        size += len(r[1])
    if vectors:
        yield ids, np.array(vectors, np.float64)


def rank(df: DataFrame, by: str, score: str, tie: str, k: int | None = None) -> DataFrame:
    """rank 1..k of each group by falling score, ties by the smaller id."""
    out = df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.col(score).desc(), tie)))
    return out if k is None else out.where(F.col("rank") <= k)


class Best:
    """The k best (score, id) of each query among those seen so far; ties go to the smaller id."""

    def __init__(self, n: int, k: int) -> None:
        self.scores, self.ids = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def add(self, at: int, scores: np.ndarray, ids: np.ndarray, exact=None, slack: float = SLACK) -> None:
        """Takes scores (queries from at on, ids); exact(queries, columns), counted in this block, scores those again that come so near to the best as slack, as the last bits of a product depend on where a row stands."""
        k, (n, m) = self.scores.shape[1], scores.shape
        own = slice(at, at + n)
        least = self.scores[own, -1]
        near = scores >= least[:, None] - slack
        if m > k and np.count_nonzero(near) > n * k:  # too many to rank: only a block's own best can stay
            least = np.maximum(least, np.partition(scores, m - k, axis=1)[:, m - k])
            near = scores >= least[:, None] - slack
        q, j = np.nonzero(near)
        real = scores[q, j] > -np.inf
        q, j = q[real], j[real]
        if not len(q):
            return
        s = scores[q, j] if exact is None else exact(q, j)
        changed = np.unique(q)
        old = self.scores[own][changed], self.ids[own][changed]
        row = np.concatenate([np.searchsorted(changed, q), np.repeat(np.arange(len(changed)), k)])
        s, i = np.concatenate([s, old[0].ravel()]), np.concatenate([ids[j], old[1].ravel()])
        order = np.lexsort((i, -s, row))
        row = row[order]
        first = np.searchsorted(row, np.arange(len(changed)))
        kept = order[first[:, None] + np.arange(k)]
        self.scores[at + changed], self.ids[at + changed] = s[kept], i[kept]

    def batches(self, qids: np.ndarray, rows: int = 1 << 16):
        """What is left, as record batches (qid, id, score)."""
        step = max(1, rows // self.scores.shape[1])
        for a in range(0, len(qids), step):
            s, i = self.scores[a : a + step], self.ids[a : a + step]
            q, j = np.nonzero(s > -np.inf)
            if len(q):
                yield pa.RecordBatch.from_arrays([pa.array(qids[a : a + step][q].astype(np.int64)), pa.array(i[q, j]), pa.array(s[q, j])], ["qid", "id", "score"])


def query_tiles(first: np.ndarray, rows: int, most: int):
    """(queries, query rows) as pairs of bounds: whole queries, whose first rows are given, of about most rows together."""
    a = 0
    while a < len(first):
        b = max(a + 1, int(np.searchsorted(first, first[a] + most, side="right")) - 1) if first[-1] - first[a] >= most else len(first)
        yield (a, b), (int(first[a]), int(first[b]) if b < len(first) else rows)
        a = b


def knn(queries: DataFrame, corpus: DataFrame, k: int, exclude_self: bool = True) -> DataFrame:
    """(qid, id, score, rank): the k rows of corpus (id, v) of the largest cosine for each query (qid, q)."""
    spark, out = corpus.sparkSession, None
    for ids, matrix in _blocks(queries, "qid", "q"):
        shared = spark.sparkContext.broadcast((np.array(ids), matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)))

        def search(batches, shared=shared):
            qids, unit = shared.value
            best = Best(len(qids), k)
            for batch in batches:
                for start in range(0, batch.num_rows, TILE):
                    part = batch.slice(start, TILE)
                    own, v = part.column("id").to_numpy(zero_copy_only=False), _matrix(part.column("v"))
                    v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
                    for a in range(0, len(qids), TILE):
                        q = unit[a : a + TILE]
                        scores = q @ v.T
                        if exclude_self:
                            scores[qids[a : a + TILE, None] == own[None, :]] = -np.inf
                        best.add(a, scores, own, lambda i, j, q=q, v=v: _dots(q, v, i, j))
            yield from best.batches(qids)

        found = corpus.select("id", "v").mapInArrow(search, "qid long, id long, score double")
        out = found if out is None else out.unionAll(found)
    if out is None:
        return spark.createDataFrame([], "qid long, id long, score double, rank int")
    return rank(out, "qid", "score", "id", k)


def _dots(q: np.ndarray, v: np.ndarray, i: np.ndarray, j: np.ndarray, most: int = 1 << 14) -> np.ndarray:
    """Dot products of rows i of q with rows j of v, each summed alike."""
    return np.concatenate([np.zeros(0), *((q[i[a : a + most]] * v[j[a : a + most]]).sum(axis=1) for a in range(0, len(i), most))])


def _maxsims(q, first: np.ndarray, v, edges: np.ndarray, i: np.ndarray, j: np.ndarray, most: int = 1 << 14, dots=_dots) -> np.ndarray:
    """MaxSim of queries i, whose tokens begin at first, with documents j, whose vectors begin at edges; both end with their number of rows. dots(q, v, tokens, vectors) gives the products of these rows."""
    out, n, m = np.empty(len(i)), np.diff(first)[i], np.diff(edges)[j]
    sizes = np.cumsum(n * m)
    a = 0
    while a < len(i):
        b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + most, side="right")))
        # a row for each token of a pair's query, and for each of these one for each vector of its document
        token = np.repeat(first[i[a:b]] - (np.cumsum(n[a:b]) - n[a:b]), n[a:b]) + np.arange(n[a:b].sum())
        size = np.repeat(m[a:b], n[a:b])
        start = np.cumsum(size) - size
        vector = np.repeat(np.repeat(edges[j[a:b]], n[a:b]) - start, size) + np.arange(size.sum())
        most_each = np.maximum.reduceat(dots(q, v, np.repeat(token, size), vector), start)
        out[a:b] = np.add.reduceat(most_each, np.cumsum(n[a:b]) - n[a:b])
        a = b
    return out


def knn_expr(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """knn by expressions alone; the same result, for small sets."""
    scored = corpus.crossJoin(small(queries)).where("id != qid").select("qid", "id", V.cosine(F.col("q"), F.col("v")).alias("score"))
    return rank(scored, "qid", "score", "id", k)


def maxsim(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """(qid, id, score): over a query's tokens (qid, qtok, q), the sum of the largest dot product with a token of document (id, v)."""
    best = corpus.crossJoin(small(queries)).select("qid", "qtok", "id", V.dot(F.col("q"), F.col("v")).alias("s")).groupBy("qid", "id", "qtok").agg(F.max("s").alias("s"))
    return best.groupBy("qid", "id").agg(F.sum("s").alias("score"))


def _query_blocks(queries: DataFrame):
    """(queries, tokens of these as one matrix, each query's first row), each block of whole queries and about BLOCK_VALUES values."""
    ids, first, rows, size = [], [], [], 0
    for r in queries.orderBy("qid", "qtok").select("qid", "q").toLocalIterator():
        if not ids or r[0] != ids[-1]:
            if size >= BLOCK_VALUES:
                yield np.array(ids), np.array(rows, np.float64), np.array(first)
                ids, first, rows, size = [], [], [], 0
            ids.append(r[0])
            first.append(len(rows))
        rows.append(r[1])
        size += len(r[1])
    if ids:
        yield np.array(ids), np.array(rows, np.float64), np.array(first)


def maxsim_topk(queries: DataFrame, documents: DataFrame, k: int) -> DataFrame:
    """(qid, id, score, rank): for each query (qid, qtok, q) the k documents (id, vs: their vectors) of the largest MaxSim.

    Queries, a bounded set, are shipped in blocks; each task scores its documents with one matrix product a
    tile and keeps its best k a query, so that k rows a query and task are shuffled, not a row a pair.
    """
    spark, out = documents.sparkSession, None
    for block in _query_blocks(queries):
        shared = spark.sparkContext.broadcast(block)

        def score(batches, shared=shared):
            qids, q, first = shared.value
            tiles, ends = list(query_tiles(first, len(q), TILE)), np.append(first, len(q))
            best = Best(len(qids), k)
            for batch in batches:
                lengths = np.diff(batch.column("vs").offsets.to_numpy()) if batch.num_rows else np.zeros(0, np.int64)
                some = np.flatnonzero(lengths)
                if not len(some):
                    continue
                ids, flat = batch.column("id").to_numpy(zero_copy_only=False)[some], _matrix(batch.column("vs").flatten())
                edges = np.concatenate([[0], np.cumsum(lengths[some])])
                for (d, e), (x, y) in query_tiles(edges[:-1], len(flat), TILE):
                    v, own = flat[x:y], edges[d : e + 1] - x
                    for (a, b), (r, t) in tiles:
                        tokens, begin = q[r:t], ends[a : b + 1] - r
                        per_query = np.add.reduceat(np.maximum.reduceat(tokens @ v.T, own[:-1], axis=1), begin[:-1], axis=0)
                        best.add(a, per_query, ids[d:e], lambda i, j, tokens=tokens, begin=begin, v=v, own=own: _maxsims(tokens, begin, v, own, i, j))
            yield from best.batches(qids)

        found = documents.select("id", "vs").mapInArrow(score, "qid long, id long, score double")
        out = found if out is None else out.unionAll(found)
    if out is None:
        return spark.createDataFrame([], "qid long, id long, score double, rank int")
    return rank(out, "qid", "score", "id", k)


def by_document(tokens: DataFrame) -> DataFrame:
    """(id, vs): a document's vectors, of rows (id, tok, v), in order."""
    return tokens.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("tok", "v"))), lambda x: x["v"]).alias("vs"))


def centroids(df: DataFrame, key: str, vec: str) -> DataFrame:
    """The mean vector of each key."""
    cells = df.select(key, F.posexplode(vec).alias("i", "x")).groupBy(key, "i").agg(F.avg("x").alias("m"))
    return cells.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias(vec))


def _document_runs(batch: pa.RecordBatch, name: str):
    """(rows, vectors of each, these as one matrix) for runs of rows of about POOLED_VALUES values, or a single row, however many a batch has."""
    lists = batch.column(name)
    if not batch.num_rows:
        return
    lengths = np.diff(lists.offsets.to_numpy())
    values = lists.flatten().flatten()
    dim = len(values) // max(1, int(lengths.sum()))
    edges = np.concatenate([[0], np.cumsum(lengths)])
    a = 0
    while a < len(lengths):
        b = max(a + 1, int(np.searchsorted(edges, edges[a] + POOLED_VALUES // max(1, dim), side="right")) - 1)
        flat = values.slice(int(edges[a]) * dim, int(edges[b] - edges[a]) * dim).to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
        yield batch.slice(a, b - a), lengths[a:b], flat.reshape(-1, dim) if dim else np.zeros((0, 0))
        a = b


def pooled(documents: DataFrame, first: int = 4, last: int = 7, k: int = 8) -> DataFrame:
    """(id, vs): documents (id, vs) as the mean of their first and last vectors, which hold no content, and the means of k clusters of the others.

    Clusters are Ward's, in order of their first vector.  A document of fewer vectors has as many clusters as it has
    others, or the mean of all alone.
    """

    def pool(batches):
        for batch in batches:
            for part, lengths, flat in _document_runs(batch, "vs"):
                rows, sizes, at = [], [], 0
                for n in lengths.tolist():
                    m, at = flat[at : at + n], at + n
                    content = m[first : max(n - last, first)]
                    special = np.concatenate([m[:first], m[max(n - last, min(first, n)) :]])
                    before = len(rows)
                    if len(special):
                        rows.append(special.mean(axis=0))
                    if len(content):
                        own = ward(content, min(k, len(content)))
                        rows += [content[own == c].mean(axis=0) for c in range(own.max() + 1)]
                    sizes.append(len(rows) - before)
                ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
                values = pa.array(np.concatenate(rows) if rows else np.zeros(0))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
                vs = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), lists)
                yield pa.RecordBatch.from_arrays([part.column("id"), vs], ["id", "vs"])

    return documents.select("id", "vs").mapInArrow(pool, "id long, vs array<array<double>>")


def rescored(chosen: DataFrame, queries: DataFrame, documents: DataFrame) -> DataFrame:
    """(qid, id, score): the exact MaxSim of chosen pairs (qid, id), 0 with a document that has no vectors; a row for each pair, not for each two tokens."""
    spark, out = chosen.sparkSession, None
    pairs = chosen.select("qid", "id").join(documents.select("id", F.col("vs").cast("array<array<double>>").alias("vs")), "id").select("qid", "id", "vs")
    for block in _query_blocks(queries):
        shared = spark.sparkContext.broadcast(block)

        def score(batches, shared=shared):
            qids, q, first = shared.value
            ends = np.append(first, len(q))
            for batch in batches:
                for part, lengths, flat in _document_runs(batch, "vs"):
                    asked, scores = part.column("qid").to_numpy(), np.zeros(part.num_rows)
                    known, some = np.isin(asked, qids), np.flatnonzero(lengths)
                    at = some[known[some]]
                    edges = np.concatenate([[0], np.cumsum(lengths)])
                    if len(at):
                        # not by matrix product, whose last bits depend on where a row stands: copies get one score
                        scores[at] = _maxsims(q, ends, flat, edges, np.searchsorted(qids, asked[at]), at)
                    rows = np.flatnonzero(known)
                    yield pa.RecordBatch.from_arrays([part.column(c).take(pa.array(rows)) for c in ("qid", "id")] + [pa.array(scores[rows])], ["qid", "id", "score"])

        # blocks are in order of qid: each has its own pairs
        found = pairs.where(F.col("qid").between(int(block[0][0]), int(block[0][-1]))).mapInArrow(score, "qid long, id long, score double")
        out = found if out is None else out.unionAll(found)
    return spark.createDataFrame([], "qid long, id long, score double") if out is None else out


def two_stage(queries: DataFrame, documents: DataFrame, pools: DataFrame, prefetch: int = 100, k: int = 10) -> DataFrame:
    """Candidates by MaxSim with pooled vectors, then MaxSim among them: (qid, id, score, rank).

    queries (qid, qtok, q); documents and pools (id, vs), the latter of `pooled`, made once for a corpus.  A scan of
    the pools gives prefetch documents a query; only these documents' own vectors are scored.
    """
    chosen = stored(maxsim_topk(queries, pools, prefetch).select("qid", "id"), "candidates")  # read by each block of queries
    return rank(rescored(chosen, queries, documents.where(F.size("vs") > 0)), "qid", "score", "id", k)


def recall(hits: DataFrame, exact: DataFrame) -> float:
    """The share of the exact hits (qid, id) that are among hits."""
    found, total = exact.join(hits.select("qid", "id"), ["qid", "id"], "left_semi").count(), exact.count()
    return found / max(total, 1)


def query_times(queries: list, run) -> tuple[float, float]:
    """Seconds that run(query), which collects its result, takes for all queries and for each on the average."""
    began = time.perf_counter()
    for q in queries:
        run(q)
    total = time.perf_counter() - began
    return total, total / max(len(queries), 1)


def ranking_metrics(hits: DataFrame, gold: DataFrame, k: int = 5) -> DataFrame:
    """One row: n, mean nDCG@k and recall@1 with one relevant document each (qid, gold); not among the hits: 0."""
    found = gold.join(hits.where(F.col("rank") <= k), "qid", "left").groupBy("qid").agg(F.min(F.when(F.col("id") == F.col("gold"), F.col("rank"))).alias("r"))
    return found.agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce(1 / F.log2(1 + F.col("r")), F.lit(0.0))), 6).alias("ndcg"), F.round(F.avg((F.coalesce("r", F.lit(0)) == 1).cast("int")), 6).alias("recall1"))


def greedy_f1(a: DataFrame, b: DataFrame) -> DataFrame:
    """Of pairs of token lists (pair, tok, v): mean best cosine of a's tokens (precision), of b's (recall), and F1."""
    sims = a.select("pair", F.col("tok").alias("i"), F.col("v").alias("x")).join(b.select("pair", F.col("tok").alias("j"), F.col("v").alias("y")), "pair").select("pair", "i", "j", V.cosine(F.col("x"), F.col("y")).alias("s"))
    p = sims.groupBy("pair", "i").agg(F.max("s").alias("s")).groupBy("pair").agg(F.avg("s").alias("p"))
    r = sims.groupBy("pair", "j").agg(F.max("s").alias("s")).groupBy("pair").agg(F.avg("s").alias("r"))
    return p.join(r, "pair").select("pair", "p", "r", F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0)).alias("f1"))


def mean_of(slices: Column) -> Column:
    """The mean vector of an array of vectors of one length."""
    n = F.size(slices)
    return F.transform(F.sequence(F.lit(0), F.size(slices[0]) - 1), lambda i: F.aggregate(slices, F.lit(0.0), lambda s, v: s + F.get(v, i)) / n)


def special_pool(tokens: Column, first: int = 4, last: int = 7) -> Column:
    """The mean of the first and last tokens of an array of vectors, which hold no content; each token counts once."""
    n = F.size(tokens)
    return F.when(n <= first + last, mean_of(tokens)).otherwise(mean_of(F.concat(F.slice(tokens, 1, first), F.slice(tokens, -last, last))))


def unpad(tokens: Column, n: Column) -> Column:
    """The last n tokens, or all if there are fewer; the padding stands before them."""
    return F.slice(tokens, F.greatest(F.size(tokens) - n, F.lit(0)) + 1, n)


def pad(tokens: Column, length: Column, empty: Column) -> tuple[Column, Column]:
    """tokens filled up to length at the end, and the mask of which are real."""
    n = F.size(tokens)
    return F.concat(tokens, F.array_repeat(empty, F.greatest(length - n, F.lit(0)))), F.transform(F.sequence(F.lit(1), length), lambda i: (i <= n).cast("int"))


def ward(vectors: np.ndarray, k: int) -> np.ndarray:
    """Cluster of each vector after merging, again and again, the two clusters whose union adds least variance; clusters are in order of their first vector.

    A chain goes from a cluster to its nearest, from that to its nearest, until two are each other's nearest: these
    are merged, as no other merge can come between them, and the distances of the union follow from its parts'.  That
    takes time and memory of the square of the vectors; the merges in order of their costs are the clustering.
    """
    n = len(vectors)
    v = np.asarray(vectors, np.float64)
    square = (v * v).sum(axis=1)
    cost = np.maximum(square[:, None] + square[None] - 2 * v @ v.T, 0) / 2
    np.fill_diagonal(cost, np.inf)
    sizes, merges, chain = np.ones(n), [], []
    left = np.ones(n, bool)
    while len(merges) < n - 1:
        if not chain:
            chain.append(int(left.argmax()))
        while True:
            at = chain[-1]
            near = int(cost[at].argmin())
            if len(chain) > 1 and cost[at, chain[-2]] <= cost[at, near]:
                near = chain[-2]
                break
            chain.append(near)
        i, j = sorted((chain.pop(), chain.pop()))
        merges.append((cost[i, j], i, j))
        total = sizes[i] + sizes[j] + sizes
        union = ((sizes[i] + sizes) * cost[i] + (sizes[j] + sizes) * cost[j] - sizes * cost[i, j]) / total
        union[~left] = union[i] = union[j] = np.inf
        cost[i], cost[:, i] = union, union
        cost[j], cost[:, j] = np.inf, np.inf
        sizes[i] += sizes[j]
        left[j] = False
    first = list(range(n))

    def top(x: int) -> int:
        while first[x] != x:
            first[x] = x = first[first[x]]
        return x

    for _, i, j in sorted(merges, key=lambda m: m[0])[: max(n - k, 0)]:
        a, b = sorted((top(i), top(j)))
        first[b] = a
    return np.unique([top(x) for x in range(n)], return_inverse=True)[1] if n else np.zeros(0, np.int64)


def context(hits: DataFrame, documents: DataFrame) -> DataFrame:
    """(qid, context): under a heading each hit (qid, id, score, rank) with its document's (id, title, text, captions) title, score, captions of pictures and text, in order of rank."""
    pictures = F.array_join(F.transform("captions", lambda c, i: F.concat(F.lit("### Image "), (i + 1).cast("string"), F.lit("\nCaption: "), c, F.lit("\n\n"))), "")
    head = F.concat(F.lit("\n\n## Document "), F.col("rank").cast("string"), F.lit(": "), "title", F.lit("\nScore: "), F.format_string("%.2f", F.col("score")), F.lit(".\n\n"))
    part = hits.join(documents, "id").select("qid", "rank", F.concat(head, pictures, F.lit("### Document Text\n"), "text").alias("part"))
    return part.groupBy("qid").agg(F.concat(F.lit("# Context"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "part"))), lambda s: s["part"]), "")).alias("context"))


def retrieve_context(queries: DataFrame, embedder, documents: DataFrame, vectors: DataFrame, pools: DataFrame, prefetch: int = 100, k: int = 10) -> DataFrame:
    """(qid, context, ids): what an agent's search tool answers to queries (qid, text): two-stage hits as a prompt, and the documents' ids by rank.

    embedder.tokens(texts) gives each text's vectors; vectors and pools are (id, vs) of the documents (id, title, text, captions).
    """

    def run(batches):
        for batch in batches:
            found = embedder.tokens([t or "" for t in batch.column("text").to_pylist()])
            rows = [(q, i, list(map(float, v))) for q, vs in zip(batch.column("qid").to_pylist(), found, strict=True) for i, v in enumerate(vs)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.list_(pa.float64())), strict=True)], ["qid", "qtok", "q"])

    asked = queries.select(F.col("qid").cast("long").alias("qid"), "text").mapInArrow(run, "qid long, qtok long, q array<double>")
    hits = two_stage(asked, vectors, pools, prefetch, k)
    ids = hits.groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda s: s["id"]).alias("ids"))
    return context(hits, documents).join(ids, "qid")
