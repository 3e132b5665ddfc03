"""An index of vectors by lists, so that a search reads only the lists near its queries.

Centres are fitted on a bounded sample (SAMPLE_ROWS rows, by the hash of their ids); every row is indexed: it is
written under its nearest centre.  How many lists a search reads is measured on the sample: as many as find the
asked share of the exact nearest rows.  Rows in lists that are not read are the price.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .retrieval import _blocks, _matrix, rank

SAMPLE_ROWS, ASKED, SPREAD = 20_000, 500, 8


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def centres(sample: np.ndarray, n: int, rounds: int = 12, seed: int = 42) -> np.ndarray:
    """n unit vectors, each the mean direction of the sample's rows that are nearest to it; a centre without rows stays."""
    unit = _unit(sample)
    found = unit[np.random.default_rng(seed).choice(len(unit), min(n, len(unit)), replace=False)]
    for _ in range(rounds):
        own = (unit @ found.T).argmax(axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, own, unit)
        some = np.linalg.norm(sums, axis=1) > 1e-12
        found[some] = _unit(sums[some])
    return found


def probes_for(sample: np.ndarray, found: np.ndarray, recall: float, k: int) -> int:
    """The least number of lists in which the k nearest rows of the sample's first rows lie, but for 1 - recall of them."""
    unit = _unit(sample)
    asked = unit[:ASKED]
    scores = asked @ unit.T
    scores[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    near = np.argsort(-scores, axis=1, kind="stable")[:, : min(k, len(unit) - 1)]
    order = np.argsort(np.argsort(-(asked @ found.T), axis=1, kind="stable"), axis=1, kind="stable")
    place = np.take_along_axis(order, (unit @ found.T).argmax(axis=1)[near], axis=1)  # how many lists come before a neighbour's
    return int(np.quantile(place, recall, method="higher")) + 1 if place.size else 1


def sign_share(corpus: DataFrame, recall: float, k: int) -> float:
    """The share of a corpus (id, v) that has to be taken by agreement of signs to hold so much of the k nearest rows, measured on a bounded sample."""
    rows = corpus.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS // 4).select("v").toPandas()["v"]  # bounded
    if len(rows) < 2:
        return 1.0
    unit = _unit(np.array(rows.tolist(), np.float64))
    asked, signs, own = unit[:ASKED], np.where(unit > 0, 1.0, -1.0), np.arange(min(ASKED, len(unit)))
    scores, agree = asked @ unit.T, signs[:ASKED] @ signs.T
    scores[own, own] = agree[own, own] = -np.inf
    near = np.argsort(-scores, axis=1, kind="stable")[:, : min(k, len(unit) - 1)]
    place = np.stack([(agree >= np.take_along_axis(agree, near[:, [i]], axis=1)).sum(axis=1) for i in range(near.shape[1])])  # rows that agree as well or better
    return float(np.quantile(place, recall, method="higher")) / len(unit)


@dataclass
class Index:
    path: str
    found: np.ndarray
    probes: int

    def rows(self, spark: SparkSession) -> DataFrame:
        """(id, v, list), a folder a list."""
        return spark.read.parquet(self.path)


def build(corpus: DataFrame, path: str, recall: float = 0.97, k: int = 10, lists: int | None = None) -> Index:
    """The index of corpus (id, v), at path: about the square root of its rows as lists.

    Up to SAMPLE_ROWS / 8 lists are fitted at once; more than these, for corpora of over six million rows, by cells, each
    on rows of its own (see `multiindex.fit`), so that lists stay short however large the corpus is.
    """
    sample = corpus.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).select("v").toPandas()["v"]  # bounded
    if not len(sample):
        corpus.select("id", "v", F.lit(0).alias("list")).write.mode("overwrite").parquet(path)
        return Index(path, np.zeros((0, 0)), 0)
    matrix = np.array(sample.tolist(), np.float64)
    wanted = lists or max(1, round(corpus.count() ** 0.5))
    if wanted > SAMPLE_ROWS // SPREAD:
        from .multiindex import fit

        found = fit(corpus.select("id", F.array("v").alias("vs")), wanted)[0]
    else:
        found = centres(matrix, wanted)
    shared = corpus.sparkSession.sparkContext.broadcast(found)  # the square root of the rows

    def assign(batches):
        for batch in batches:
            own = (_unit(_matrix(batch.column("v"))) @ shared.value.T).argmax(axis=1) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(own.astype(np.int32))], ["id", "v", "list"])

    placed = corpus.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")).mapInArrow(assign, "id long, v array<double>, list int")
    # a list that holds many of all rows is written by several tasks
    placed.repartition("list", F.pmod(F.xxhash64("id"), F.lit(SPREAD))).write.mode("overwrite").partitionBy("list").parquet(path)
    return Index(path, found, probes_for(matrix, found, recall, k))


def search(index: Index, queries: DataFrame, k: int, exclude_self: bool = True) -> DataFrame:
    """(qid, id, score, rank): the k rows of the largest cosine among the lists nearest to each query (qid, q); only those lists are read."""
    spark, out = queries.sparkSession, None
    for ids, matrix in _blocks(queries, "qid", "q"):
        unit = _unit(matrix)
        near = np.argsort(-(unit @ index.found.T), axis=1, kind="stable")[:, : index.probes]
        asks = np.zeros((len(index.found), len(ids)), bool)
        asks[near.T, np.arange(len(ids))] = True
        shared = spark.sparkContext.broadcast((np.array(ids), unit, asks))

        def look(batches, shared=shared):
            qids, unit, asks = shared.value
            best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for batch in batches:
                own, v, of = (batch.column(c) for c in ("id", "v", "list"))
                own, v, of = own.to_numpy(zero_copy_only=False), _unit(_matrix(v)) if batch.num_rows else np.zeros((0, 1)), of.to_numpy(zero_copy_only=False)
                for n in np.unique(of).tolist():
                    at, some = np.flatnonzero(of == n), np.flatnonzero(asks[n])
                    for i, row in zip(some.tolist(), unit[some] @ v[at].T, strict=True):
                        mine = own[at] != qids[i] if exclude_self else slice(None)
                        s, d = row[mine], own[at][mine]
                        if i in best:
                            s, d = np.concatenate([best[i][0], s]), np.concatenate([best[i][1], d])
                        if len(s) > 2 * k:  # all that tie with the k-th go on
                            near = s >= np.partition(s, -k)[-k]
                            s, d = s[near], d[near]
                        by = np.lexsort((d, -s))[:k]
                        best[i] = s[by], d[by]
            for i, (s, d) in best.items():
                if len(s):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), qids[i])), pa.array(d), pa.array(s)], ["qid", "id", "score"])

        wanted = sorted(set(near.ravel().tolist()))
        found = index.rows(spark).where(F.col("list").isin(wanted)).select("id", "v", "list").mapInArrow(look, "qid long, id long, score double")
        out = found if out is None else out.unionAll(found)
    if out is None:
        return spark.createDataFrame([], "qid long, id long, score double, rank int")
    return rank(out, "qid", "score", "id", k)
