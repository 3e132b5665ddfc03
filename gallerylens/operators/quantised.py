"""Late interaction on packed sign bits: vectors of any dimension as a few bits a dimension.

A vector is coded in planes.  The first plane holds its signs and the mean of its absolute values; what that leaves is
coded by the next plane in the same way, and so on: one plane is one bit a dimension, four planes come near to the
vector itself at a sixteenth of its doubles.  Dot products of codes are sums over pairs of planes of the bits that
differ, counted in machine words.

A first stage ranks all documents by the MaxSim of codes without looking at vectors; `planes_for` measures on a bounded
sample how many planes a stated recall needs for a stated share of candidates.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .retrieval import SLACK, TILE, Best, _matrix, _maxsims, _query_blocks, query_tiles, rank, rescored
from .scratch import stored

#: Query tokens times vectors that are scored at once; documents and values of a sample; queries among these.
CELLS, SAMPLE_DOCUMENTS, SAMPLE_VALUES, SAMPLE_QUERIES = 1 << 20, 2_000, 8 << 20, 100


def encode(vectors: np.ndarray, planes: int) -> tuple[np.ndarray, np.ndarray]:
    """(n, planes, words) bits in machine words and (n, planes) scales of n vectors; a vector of zeros has scales of 0."""
    rest, n, dim = np.array(vectors, np.float64), *vectors.shape
    bits, scales = np.zeros((n, planes, -(-dim // 64) * 8), np.uint8), np.zeros((n, planes), np.float32)
    for p in range(planes):
        positive = rest > 0
        scales[:, p] = np.abs(rest).mean(axis=1) if dim else 0
        packed = np.packbits(positive, axis=1, bitorder="little")
        bits[:, p, : packed.shape[1]] = packed
        rest -= np.where(positive, 1.0, -1.0) * scales[:, p, None]
    return bits.view(np.uint64), scales


def decode(bits: np.ndarray, scales: np.ndarray, dim: int) -> np.ndarray:
    """The vectors that codes stand for."""
    on = np.unpackbits(bits.view(np.uint8), axis=2, bitorder="little")[:, :, :dim]
    return ((2.0 * on - 1) * scales[:, :, None]).sum(axis=1)


def dots(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], dim: int) -> np.ndarray:
    """Dot products of the coded vectors of a with those of b, by counting bits."""
    out = np.zeros((len(a[0]), len(b[0])))
    for p in range(a[0].shape[1]):
        for r in range(b[0].shape[1]):
            differ = np.zeros(out.shape, np.int32)
            for w in range(a[0].shape[2]):
                differ += np.bitwise_count(a[0][:, None, p, w] ^ b[0][None, :, r, w])
            out += np.outer(a[1][:, p].astype(np.float64), b[1][:, r]) * (dim - 2 * differ)
    return out


def _code_dots(dim: int):
    """dots(a, b, i, j): the products of rows i of a with rows j of b, summed as `dots` does."""

    def run(a, b, i: np.ndarray, j: np.ndarray, most: int = 1 << 14) -> np.ndarray:
        out = np.zeros(len(i))
        for at in range(0, len(i), most):
            x, y = i[at : at + most], j[at : at + most]
            bits, scales, other, others = a[0][x], a[1][x].astype(np.float64), b[0][y], b[1][y]
            for p in range(bits.shape[1]):
                for r in range(bits.shape[1]):
                    differ = np.bitwise_count(bits[:, p] ^ other[:, r]).sum(axis=1, dtype=np.int32)
                    out[at : at + most] += scales[:, p] * others[:, r] * (dim - 2 * differ)
        return out

    return run


def codes(documents: DataFrame, planes: int = 4) -> DataFrame:
    """(id, n, dim, bits, scales) of documents (id, vs: vectors of one dimension): made once for a corpus.

    A document without vectors has n = 0 and is no candidate; repeated ids are documents of their own.
    """

    def run(batches):
        for batch in batches:
            vs = batch.column("vs")
            lengths = np.diff(vs.offsets.to_numpy()) if batch.num_rows else np.zeros(0, np.int64)
            flat = _matrix(vs.flatten()) if lengths.sum() else np.zeros((0, 0))
            bits, scales = encode(flat, planes)
            edges = np.concatenate([[0], np.cumsum(lengths)]).tolist()
            own = [(bits[a:b].tobytes(), scales[a:b].tobytes()) for a, b in zip(edges, edges[1:], strict=False)]
            columns = [batch.column("id"), pa.array(lengths, pa.int32()), pa.array(np.full(len(own), flat.shape[1]), pa.int32()), pa.array([x for x, _ in own], pa.binary()), pa.array([x for _, x in own], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "dim", "bits", "scales"])

    return documents.select(F.col("id").cast("long").alias("id"), F.coalesce("vs", F.array()).cast("array<array<double>>").alias("vs")).mapInArrow(run, "id long, n int, dim int, bits binary, scales binary")


def _coded(batch: pa.RecordBatch, planes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(rows that have vectors, first vector of each and the end, bits, scales, dimensions)."""
    lengths = batch.column("n").to_numpy()
    some = np.flatnonzero(lengths)
    dim = int(batch.column("dim").to_numpy()[some].max()) if len(some) else 0
    bits = np.frombuffer(b"".join(batch.column("bits").to_pylist()), np.uint64).reshape(-1, planes, -(-dim // 64) or 1)
    scales = np.frombuffer(b"".join(batch.column("scales").to_pylist()), np.float32).reshape(-1, planes)
    return some, np.concatenate([[0], np.cumsum(lengths[some])]), bits, scales, dim


def _maxsim(asked: tuple[np.ndarray, np.ndarray], first: np.ndarray, edges: np.ndarray, bits: np.ndarray, scales: np.ndarray, dim: int) -> np.ndarray:
    """MaxSim of each query with each document, a block of documents at a time."""
    out, at, n = [], 0, len(edges) - 1
    while at < n:
        stop = max(at + 1, int(np.searchsorted(edges, edges[at] + max(1, CELLS // max(1, len(asked[0]))), side="right")) - 1)
        a, b = edges[at], edges[stop]
        product = dots(asked, (bits[a:b], scales[a:b]), dim)
        out.append(np.add.reduceat(np.maximum.reduceat(product, edges[at:stop] - a, axis=1), first, axis=0))
        at = stop
    return np.concatenate(out, axis=1) if out else np.zeros((len(first), 0))


def candidates(queries: DataFrame, coded: DataFrame, k: int, planes: int = 4, exclude_self: bool = False) -> DataFrame:
    """(qid, id, score, rank): the k documents of the largest MaxSim of codes (of `codes` with as many planes) for each query (qid, qtok, q); ties by id.

    Queries, a bounded set, are shipped in blocks; a task keeps its best k a query.  Bits are counted for those pairs
    alone that the product of the vectors, for which the codes stand, leaves near to the best.
    """
    spark, out = coded.sparkSession, None
    for qids, q, first in _query_blocks(queries):
        shared = spark.sparkContext.broadcast((qids, encode(q, planes), first))

        def score(batches, shared=shared):
            qids, asked, first = shared.value
            tiles, ends, best = list(query_tiles(first, len(asked[0]), TILE)), np.append(first, len(asked[0])), Best(len(qids), k)
            for batch in batches:
                some, edges, bits, scales, dim = _coded(batch, planes)
                if not len(some):
                    continue
                ids, counted = batch.column("id").to_numpy(zero_copy_only=False)[some], _code_dots(dim)
                for (d, e), (x, y) in query_tiles(edges[:-1], len(bits), TILE):
                    near, own, coded_own = decode(bits[x:y], scales[x:y], dim), edges[d : e + 1] - x, (bits[x:y], scales[x:y])
                    for (a, b), (r, t) in tiles:
                        tokens, begin, coded_tokens = decode(asked[0][r:t], asked[1][r:t], dim), ends[a : b + 1] - r, (asked[0][r:t], asked[1][r:t])
                        tile = np.add.reduceat(np.maximum.reduceat(tokens @ near.T, own[:-1], axis=1), begin[:-1], axis=0)
                        if exclude_self:
                            tile[qids[a:b, None] == ids[None, d:e]] = -np.inf
                        # more than the sums of a product's rounding, for the longest query and vectors
                        slack = SLACK * np.diff(begin).max() * np.sqrt((tokens**2).sum(axis=1).max() * (near**2).sum(axis=1).max())
                        best.add(a, tile, ids[d:e], lambda i, j, q=coded_tokens, begin=begin, v=coded_own, own=own, counted=counted: _maxsims(q, begin, v, own, i, j, dots=counted), slack)
            yield from best.batches(qids)

        found = coded.mapInArrow(score, "qid long, id long, score double")
        out = found if out is None else out.unionAll(found)
    if out is None:
        return spark.createDataFrame([], "qid long, id long, score double, rank int")
    return rank(out, "qid", "score", "id", k)


def _pairs_scored(queries: DataFrame, pairs: DataFrame, score) -> DataFrame:
    """(qid, id, score) of pairs with more columns: score(batch, rows, tokens of the query) for the rows of each query, queries being shipped in blocks."""
    spark, out = pairs.sparkSession, None
    for qids, q, first in _query_blocks(queries):
        shared = spark.sparkContext.broadcast((qids, q, first))

        def run(batches, shared=shared):
            qids, q, first = shared.value
            tokens = dict(zip(qids.tolist(), np.split(q, first[1:]), strict=True))
            for batch in batches:
                asked, ids = batch.column("qid").to_numpy(), batch.column("id").to_numpy()
                for one in np.unique(asked).tolist():
                    if one in tokens:
                        rows = np.flatnonzero(asked == one)
                        yield pa.RecordBatch.from_arrays([pa.array(asked[rows]), pa.array(ids[rows]), pa.array(score(batch.take(pa.array(rows)), tokens[one]))], ["qid", "id", "score"])

        # blocks are in order of qid: each has its own pairs
        found = pairs.where(F.col("qid").between(int(qids[0]), int(qids[-1]))).mapInArrow(run, "qid long, id long, score double")
        out = found if out is None else out.unionAll(found)
    return spark.createDataFrame([], "qid long, id long, score double") if out is None else out


def narrowed(chosen: DataFrame, queries: DataFrame, coded: DataFrame, k: int, planes: int = 4) -> DataFrame:
    """(qid, id): the k of each query's chosen pairs whose codes score best."""

    def score(batch, q):
        some, *own = _coded(batch, planes)
        out = np.zeros(batch.num_rows)
        out[some] = _maxsim(encode(q, planes), np.zeros(1, np.int64), *own)[0]
        return out

    return rank(_pairs_scored(queries, chosen.select("qid", "id").join(coded, "id").select("qid", *coded.columns), score), "qid", "score", "id", k).select("qid", "id")


def two_stage(queries: DataFrame, documents: DataFrame, pools: DataFrame, prefetch: int = 100, k: int = 10, planes: int = 4, full: DataFrame | None = None, oversample: float = 2.0) -> DataFrame:
    """(qid, id, score, rank) for queries (qid, qtok, q): prefetch candidates by codes alone, then exact MaxSim among them.

    pools are the `codes` of pooled vectors, or of all; only the candidates' vectors are read.  full, the codes of all
    vectors, cuts the candidates to ceil(k * oversample) before any vector is.
    """
    chosen = stored(candidates(queries, pools, prefetch, planes), "candidates")  # read by each block of queries
    if full is not None:
        chosen = narrowed(chosen, queries, full, math.ceil(k * oversample), planes)
    return rank(rescored(chosen, queries, documents), "qid", "score", "id", k)


def binary_topk(queries: DataFrame, corpus: DataFrame, k: int, oversample: float = 2.0, planes: int = 1) -> DataFrame:
    """(qid, id, score, rank): of corpus (id, v) the ceil(k * oversample) whose codes are nearest to each query (qid, q), rescored by cosine; the query's own row is left out."""
    unit = lambda c: F.transform(c, lambda x: x / F.greatest(F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, y: s + y * y)), F.lit(1e-300)))
    asked = queries.select("qid", F.lit(0).alias("qtok"), unit(F.col("q").cast("array<double>")).alias("q"))
    own = corpus.select("id", F.array(unit(F.col("v").cast("array<double>"))).alias("vs"))
    chosen = stored(candidates(asked, codes(own, planes), math.ceil(k * oversample), planes, exclude_self=True), "candidates")  # read by each block of queries
    return rank(rescored(chosen, asked, own), "qid", "score", "id", k)


def places(documents: list[np.ndarray], planes: int, k: int) -> np.ndarray:
    """For the first documents as queries, how many documents come up to each of their k nearest in the order of codes, as a share of all."""
    edges = np.concatenate([[0], np.cumsum([len(d) for d in documents])])
    flat, n = np.concatenate(documents), len(documents)
    asked = min(SAMPLE_QUERIES, n)
    first, q = edges[:asked], flat[: edges[asked]]
    exact = np.add.reduceat(np.maximum.reduceat(q @ flat.T, edges[:-1], axis=1), first, axis=0)
    bits, scales = encode(flat, planes)
    near = _maxsim((bits[: edges[asked]], scales[: edges[asked]]), first, edges, bits, scales, flat.shape[1])
    order = np.argsort(np.argsort(-near, axis=1, kind="stable"), axis=1, kind="stable")
    return (np.take_along_axis(order, np.argsort(-exact, axis=1, kind="stable")[:, :k], axis=1) + 1) / n


def planes_for(documents: DataFrame, recall: float = 0.9, share: float = 0.05, k: int = 10, most: int = 6) -> int:
    """The least number of planes, most at most, with which that share of the corpus holds so much of the k nearest documents.

    Measured on a bounded sample by the hash of ids: SAMPLE_DOCUMENTS documents, or fewer where these have more than
    SAMPLE_VALUES values.
    """
    size = documents.agg(F.avg(F.size("vs") * F.size(F.get("vs", F.lit(0))))).first()[0] or 1
    sample = documents.where(F.size("vs") > 0).orderBy(F.xxhash64("id"), "id").limit(max(20, min(SAMPLE_DOCUMENTS, int(SAMPLE_VALUES / size)))).select("vs").toPandas()["vs"]  # bounded
    held = [np.array([list(v) for v in vs], np.float64) for vs in sample]
    if len(held) < 2:
        return 1
    return next((p for p in range(1, most) if (places(held, p, k) <= share).mean() >= recall), most)
