"""Entity alignment: normalised keys, overrides, best candidates and what stays unmatched."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .retrieval import BLOCK_VALUES, _matrix as matrix_of


def align(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left (lid, keys...) and right (rid, keys...) that agree in all keys."""
    return left.join(right, keys).select("lid", "rid", *keys)


def matches(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., n): how many pairs of `align` each key has, which needs no pair: the rows of either side are counted first."""
    mine, other = (side.groupBy(*keys).agg(F.count("*").alias(name)) for side, name in ((left, "_l"), (right, "_r")))
    return mine.join(other, keys).select(*keys, (F.col("_l") * F.col("_r")).alias("n"))


def unmatched(left: DataFrame, right: DataFrame) -> DataFrame:
    """Why a left row (lid, title_key, artist_key) has no partner: no such title, or no such artist for it."""
    titles = left.join(right, "title_key", "left_anti").select("lid", F.lit("title").alias("miss"))
    known = left.join(right, "title_key", "left_semi")
    return titles.unionAll(known.join(right, ["title_key", "artist_key"], "left_anti").select("lid", F.lit("artist").alias("miss")))


def override(rows: DataFrame, aliases: DataFrame, overrides: DataFrame) -> DataFrame:
    """Artists replaced by alias (artist, alias) first, then by (title, alias) override; neither: as they are."""
    first = rows.join(aliases, "artist", "left").withColumn("artist_now", F.coalesce("alias", "artist")).drop("alias")
    to = overrides.select("title", F.col("artist").alias("artist_now"), F.col("override"))
    return first.join(to, ["title", "artist_now"], "left").withColumn("resolved", F.coalesce("override", "artist_now")).drop("override", "artist_now")


def best_candidate(queries: DataFrame, candidates: DataFrame, on: str) -> DataFrame:
    """For each query (id, on, v) the candidate (cid, on, c) of the largest cosine above 0, ties to the smallest cid; itself is none.

    Queries, a bounded set, are shipped in blocks; a task compares its candidates with those of the same key by one
    matrix product and passes on one candidate a query, not a row a pair.
    """
    spark, out = candidates.sparkSession, None
    for ids, keys, matrix in _keyed_blocks(queries, on):
        shared = spark.sparkContext.broadcast((np.array(ids), keys, matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)))

        def run(batches, shared=shared):
            qids, keys, unit = shared.value
            of: dict[object, list[int]] = {}
            for i, key in enumerate(keys):
                of.setdefault(key, []).append(i)
            best: dict[int, tuple[float, int]] = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                v, own = matrix_of(batch.column("c")), batch.column("cid").to_numpy(zero_copy_only=False)
                v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
                held: dict[object, list[int]] = {}
                for j, key in enumerate(batch.column(on).to_pylist()):
                    held.setdefault(key, []).append(j)
                for key, rows in held.items():
                    asked = of.get(key) if key is not None else None
                    if not asked:
                        continue
                    order = np.array(rows)[np.argsort(own[rows], kind="stable")]  # the smallest cid first
                    scores = unit[asked] @ v[order].T
                    scores[qids[asked][:, None] == own[order][None, :]] = -np.inf
                    for i, row, j in zip(asked, scores, scores.argmax(axis=1).tolist(), strict=True):
                        found = (-float(row[j]), int(own[order[j]]))
                        if found[0] < 0:
                            best[i] = min(best.get(i, found), found)
            rows = [(int(qids[i]), c, -s) for i, (s, c) in best.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["id", "best", "score"])

        found = candidates.select("cid", on, "c").mapInArrow(run, "id long, best long, score double")
        out = found if out is None else out.unionAll(found)
    if out is None:
        return spark.createDataFrame([], "id long, best long, score double")
    first = F.max_by(F.struct("best", "score"), F.struct("score", (-F.col("best")).alias("t")))
    return out.groupBy("id").agg(first.alias("b")).select("id", "b.best", "b.score")


def _keyed_blocks(queries: DataFrame, on: str):
    """(ids, keys, matrix) of about BLOCK_VALUES values; the query set streams through the driver."""
    ids, keys, rows, size = [], [], [], 0
    for r in queries.select("id", on, "v").toLocalIterator():
        if size >= BLOCK_VALUES:
            yield ids, keys, np.array(rows, np.float64)
            ids, keys, rows, size = [], [], [], 0
        ids.append(r[0])
        keys.append(r[1])
        rows.append(r[2])
        size += len(r[2])
    if ids:
        yield ids, keys, np.array(rows, np.float64)
