"""Similarity join of two large tables of vectors: for each row of the left the nearest row of the right.

Vectors are hashed to bands of sign bits of random directions; rows of both sides meet where a band is equal.  Bits
follow from the size of the right side, so that a bucket holds about BUCKET rows however large the table is; bands
follow from a bounded sample, for a stated recall.  A bucket is scored in blocks on packed codes (see `quantised`), which
travel instead of vectors, and passes on a few partners a left row; these are checked by their vectors.

Equal vectors meet once, by their smallest id.  A bucket that holds many rows of either side is dealt out as blocks of
BLOCK by BLOCK rows, all of which are scored: no row is left out of a bucket, and no task holds one whole.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .index import _unit
from .quantised import dots, encode
from .ranks import small
from .retrieval import _matrix
from .scratch import stored

BUCKET, BLOCK, SAMPLE_ROWS, ASKED, MOST_BANDS, PLANES, SEED = 64, 2_048, 10_000, 500, 64, 4, 42


def directions(dim: int, bands: int, bits: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dim, bands * bits))


def band_keys(v: np.ndarray, bands: int, bits: int) -> np.ndarray:
    """(rows, bands): each band's number and its sign bits in one long."""
    on = (v @ directions(v.shape[1], bands, bits) > 0).reshape(len(v), bands, bits)
    return (on << np.arange(bits)).sum(axis=2) | (np.arange(bands) << 40)


def bands_for(left: np.ndarray, right: np.ndarray, bits: int, recall: float) -> int:
    """The least number of bands in one of which so many of the left rows meet their nearest of the right rows.

    Of a sample: in the whole table the nearest rows are no farther, so that no fewer meet.
    """
    near = (_unit(left) @ _unit(right).T).argmax(axis=1)
    met = band_keys(left, MOST_BANDS, bits) == band_keys(right, MOST_BANDS, bits)[near]
    found = np.logical_or.accumulate(met, axis=1).mean(axis=0)
    return int(np.argmax(found >= recall)) + 1 if (found >= recall).any() else MOST_BANDS


def _sample(df: DataFrame, n: int) -> np.ndarray:
    rows = df.orderBy(F.xxhash64("id"), "id").limit(n).select("v").toPandas()["v"]  # bounded
    return np.array(rows.tolist(), np.float64) if len(rows) else np.zeros((0, 0))


def _distinct(df: DataFrame) -> DataFrame:
    """(id, v): each vector once, by its smallest id; vectors without a length have no direction and meet nobody."""
    v = F.col("v").cast("array<double>")
    long = F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x) > 0
    return df.select(F.col("id").cast("long").alias("id"), v.alias("v")).where(long).groupBy("v").agg(F.min("id").alias("id"))


def _hashed(df: DataFrame, bands: int, bits: int) -> DataFrame:
    """(key, id, bits, scales): a row for each band."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _unit(_matrix(batch.column("v")))
            words, scales = encode(unit, PLANES)
            keys = band_keys(unit, bands, bits)
            own = pa.array([x.tobytes() for x in words], pa.binary()), pa.array([x.tobytes() for x in scales], pa.binary())
            for b in range(bands):
                yield pa.RecordBatch.from_arrays([pa.array(keys[:, b]), batch.column("id"), *own], ["key", "id", "bits", "scales"])

    return df.select("id", "v").mapInArrow(run, "key long, id long, bits binary, scales binary")


def _dealt(rows: DataFrame, blocks: DataFrame, own: str, other: str) -> DataFrame:
    """Rows with the block (key, l, r) in which they are scored: one of their own side's, and every one of the other's."""
    placed = rows.join(small(blocks), "key").withColumn(own, F.pmod(F.xxhash64("id"), F.col(f"n_{own}")).cast("int"))
    return placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"n_{other}") - 1))).select("key", "l", "r", "id", "bits", "scales")


def nearest_partners(left: DataFrame, right: DataFrame, recall: float = 0.95, partners: int = 8, least: float | None = None, bands: int | None = None) -> DataFrame:
    """(id, partner, score): for each row of left (id, v) the row of right (id, v) of the largest cosine that shares a band with it, if it is least or more.

    Rows that share no band with any have no partner; of equal vectors on the right the smallest id counts.  Rows
    with an empty vector, or one of zeros, meet nobody, and repeated ids are rows of their own.
    """
    spark = left.sparkSession
    lefts, rights = stored(_distinct(left), "left"), stored(_distinct(right), "right")
    n = rights.count()
    bits = max(1, min(32, round(math.log2(max(n, 2) / BUCKET))))
    if bands is None:
        a, b = _sample(lefts, ASKED), _sample(rights, SAMPLE_ROWS)
        bands = bands_for(a, b, bits, recall) if len(a) and len(b) else 1
    x, y = stored(_hashed(lefts, bands, bits), "hashed"), stored(_hashed(rights, bands, bits), "hashed")
    sizes = x.groupBy("key").agg(F.count("*").alias("nl")).join(y.groupBy("key").agg(F.count("*").alias("nr")), "key")
    count = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    blocks = stored(sizes.select("key", count("nl").alias("n_l"), count("nr").alias("n_r")), "blocks")

    def score(key, a, b):
        if not a.num_rows or not b.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], ["id", "partner", "s"])
        code = lambda t: (np.frombuffer(b"".join(t.column("bits").to_pylist()), np.uint64).reshape(t.num_rows, PLANES, -1), np.frombuffer(b"".join(t.column("scales").to_pylist()), np.float32).reshape(t.num_rows, PLANES))
        ours, theirs = code(a), code(b)
        own, other = a.column("id").to_numpy(), b.column("id").to_numpy()
        out = []
        for at in range(0, len(own), 256):
            near = dots((ours[0][at : at + 256], ours[1][at : at + 256]), theirs, 64 * ours[0].shape[2])
            best = np.argpartition(-near, partners, axis=1)[:, :partners] if near.shape[1] > partners else np.tile(np.arange(near.shape[1]), (len(near), 1))
            out.append((np.repeat(own[at : at + 256], best.shape[1]), other[best].ravel(), np.take_along_axis(near, best, axis=1).ravel()))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["id", "partner", "s"])

    met = _dealt(x, blocks, "l", "r").groupBy("key", "l", "r").cogroup(_dealt(y, blocks, "r", "l").groupBy("key", "l", "r")).applyInArrow(score, "id long, partner long, s double")
    few = stored(met.dropDuplicates(["id", "partner"]).withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy(F.col("s").desc(), "partner"))).where(F.col("k") <= partners).select("id", "partner"), "partners")
    pairs = few.join(lefts, "id").join(rights.select(F.col("id").alias("partner"), F.col("v").alias("w")), "partner")
    length = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, z: s + z * z))
    cosine = F.aggregate(F.zip_with("v", "w", lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z) / (length(F.col("v")) * length(F.col("w")))
    best = pairs.select("v", F.struct(cosine.alias("score"), (-F.col("partner")).alias("last")).alias("best")).groupBy("v").agg(F.max("best").alias("best"))
    found = best.select("v", (-F.col("best.last")).alias("partner"), F.col("best.score").alias("score"))
    if least is not None:
        found = found.where(F.col("score") >= least)
    return left.select("id", F.col("v").cast("array<double>").alias("v")).join(found, "v").select("id", "partner", "score")
