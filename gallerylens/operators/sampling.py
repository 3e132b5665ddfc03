"""Samples, splits and shuffles that depend on a seed and the id alone, so that every run and engine agrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .ranks import ranked, small


def bucket(c: Column, n: int) -> Column:
    """A number below n by the md5 of a string."""
    return F.conv(F.substring(F.md5(c), 1, 6), 16, 10).cast("long") % n


def seeded(c: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), c.cast("string")))


def shuffle(df: DataFrame, id_col: str, seed: int = 42) -> DataFrame:
    """df with its place in a shuffled order."""
    out = ranked(df, [seeded(F.col(id_col), seed), id_col], name="place")
    return out.withColumn("place", F.col("place") + 1)


def stratified_split(df: DataFrame, stratum: str, id_col: str, shares: list[tuple[str, float]], seed: int = 42) -> DataFrame:
    """df with a split: each stratum is shuffled and cut at the running shares of its size."""
    at, split, total = (F.col("_rank") + 1) / F.col("_n"), None, 0.0
    for name, share in shares[:-1]:
        total += share
        split = (F.when if split is None else split.when)(at <= round(total, 9), name)
    sizes = df.groupBy(stratum).agg(F.count("*").alias("_n"))
    placed = ranked(df, [seeded(F.col(id_col), seed), id_col], [stratum], "_rank").join(small(sizes), stratum)
    return placed.select(*df.columns, split.otherwise(shares[-1][0]).alias("split"))


def sample_sizes(df: DataFrame, stratum: str, n: int) -> DataFrame:
    """(stratum, take): n in proportion, each half-even rounded, what is left over added to the largest stratum."""
    counts = df.groupBy(stratum).agg(F.count("*").alias("_c"))  # a row for each stratum
    every = Window.partitionBy(F.lit(0))
    sized = counts.withColumn("take", F.bround(F.lit(float(n)) * F.col("_c") / F.sum("_c").over(every)).cast("long"))
    rest = F.lit(n) - F.sum("take").over(every)
    first = F.row_number().over(every.orderBy(F.col("_c").desc(), stratum)) == 1
    return sized.select(stratum, (F.col("take") + F.when(first, rest).otherwise(0)).alias("take"))


def stratified_sample(df: DataFrame, stratum: str, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """n rows, each stratum in proportion."""
    placed = ranked(df, [seeded(F.col(id_col), seed), id_col], [stratum], "_rank")
    return placed.join(small(sample_sizes(df, stratum, n)), stratum).where("_rank < take").select(*df.columns)


def half_half(df: DataFrame, size: str, least: int, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """n/2 rows whose size is just least, and n/2 above."""

    def some(rows: DataFrame) -> DataFrame:
        return rows.orderBy(seeded(F.col(id_col), seed), id_col).limit(n // 2)

    return some(df.where(F.col(size) == least)).unionByName(some(df.where(F.col(size) > least)))
