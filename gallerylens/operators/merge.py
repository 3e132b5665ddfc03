"""Merging, resuming and keeping first or last rows; every choice has an order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .ranks import ranked


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key by order."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", n).where("_n = 1").drop("_n")


def merge(old: DataFrame, new: DataFrame, keys: list[str], new_wins: bool) -> DataFrame:
    """The union of old and new with one row for each key; rows of one side share no key."""
    both = old.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)))
    return keep_first(both, keys, [F.col("_side").desc() if new_wins else F.col("_side")]).drop("_side")


def resume(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is not done yet."""
    return todo.join(done.select(key), key, "left_anti")


def watermark(done: DataFrame, key: str) -> DataFrame:
    """One row: the largest key done, 0 where nothing is."""
    return done.agg(F.coalesce(F.max(key), F.lit(0)).alias("high"))


def above_watermark(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows above the largest key done; unlike resume, gaps below it are passed over."""
    return todo.crossJoin(F.broadcast(watermark(done, key))).where(F.col(key) > F.col("high")).drop("high")


def coverage(rows: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """One row: total, matched and missing of rows by key."""
    marks = found.select(key).distinct().withColumn("_hit", F.lit(1))
    return rows.select(key).join(marks, key, "left").agg(F.count("*").alias("total"), F.count("_hit").alias("matched"), F.count_if(F.col("_hit").isNull()).alias("missing"))


def zip_rows(left: DataFrame, right: DataFrame, order: str, checked: str) -> DataFrame:
    """Rows of two tables by position; raises where the checked column differs."""
    a = ranked(left, [order], name="pos")
    b = ranked(right, [order], name="pos").withColumnRenamed(checked, "_r").drop(order)
    return a.join(b, "pos").where(F.assert_true(F.col(checked) == F.col("_r"), F.lit("rows differ")).isNull()).drop("_r")
