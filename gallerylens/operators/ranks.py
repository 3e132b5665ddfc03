"""Ranks over a whole table or large groups without gathering them in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .scratch import stored

#: A side of at most so many rows is broadcast; a larger one is left to the planner's shuffle.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it is counted to have few rows, else df as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def ranked(df: DataFrame, order: list[Column | str], group: list[str] | None = None, name: str = "rank") -> DataFrame:
    """df with its 0-based rank by order, within each group or over all.

    Rows are dealt out by ranges of group and order and written once; a range's rows are numbered by its own
    task, and the counts of the ranges before it, a row for each range and group, give where it starts.  The
    order should end with an id, as rows that tie are numbered arbitrarily.
    """
    group = group or []
    keys = [F.col(g) for g in group] + [F.col(o) if isinstance(o, str) else o for o in order]
    named = df.select("*", *(k.alias(f"_k{i}") for i, k in enumerate(keys)))
    own = [f"_k{i}" for i in range(len(keys))]
    dealt = stored(named.repartitionByRange(*own).withColumn("_range", F.spark_partition_id()), "ranked")
    counts = dealt.groupBy(*group, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*group, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy(*group, "_range").orderBy(*own[len(group) :])) - 1
    # groups may be null: null-safe equality keeps their rows
    right = starts.select(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(group)), F.col("_range").alias("_r"), "_start")
    same = F.col("_range") == F.col("_r")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    numbered = dealt.withColumn("_within", within).join(small(right), same)
    return numbered.select(*df.columns, (F.col("_start") + F.col("_within")).alias(name))
