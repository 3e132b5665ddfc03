"""Streams over files that are already there: each query ends when all of them are read.

A checkpoint folder makes a run resumable: a second run over the same folder reads only new files.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.scratch import folder


def files(spark: SparkSession, root: str, name: str, like: DataFrame) -> DataFrame:
    """The Parquet file or folder `name` below root as a stream with the schema of like."""
    return spark.readStream.schema(like.schema).parquet(f"{root}/{name}*")


def run(stream: DataFrame, mode: str, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Runs a stream until its present input is read; each gets every batch and its number."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
    query.awaitTermination()


def latest(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """What a stream holds at its end: the last complete batch, or all batches appended. Batches are written by number, so a repeated one replaces itself."""
    spark = stream.sparkSession
    out = folder(spark, name)
    seen: list[int] = []

    def write(df: DataFrame, n: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={n}")
        seen.append(n)

    run(stream, mode, write, folder(spark, f"{name}-checkpoint"))
    read = [max(seen)] if mode == "complete" and seen else seen
    if not read:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(*(f"{out}/batch={n}" for n in read))


def running_sums(stream: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, total): what an accumulating metric holds."""
    return stream.groupBy(key).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"))


def accumulate(stream: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n, chars): state that only ever grows, one row for each key that a batch changes."""

    def grow(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, chars = state.get if state.exists else (0, 0)
        for pdf in batches:
            n, chars = n + len(pdf), chars + int(pdf[text].fillna("").str.len().sum())
        state.update((n, chars))
        yield pd.DataFrame({key: [k[0]], "n": [n], "chars": [chars]})

    return stream.select(key, text).groupBy(key).applyInPandasWithState(grow, f"{key} long, n long, chars long", "n long, chars long", "update", GroupStateTimeout.NoTimeout)


def new_ids(stream: DataFrame, key: str) -> DataFrame:
    """Each id once, however often it comes."""
    return stream.select(key).dropDuplicates([key])


def tumbling(events: DataFrame, size: str = "1 day", slide: str | None = None, late: str | None = None) -> DataFrame:
    """Counts and sums by window and type; for batch tables and, with a bound on late rows, for streams."""
    rows = events.withWatermark("ts", late) if late else events
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return rows.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    """(user_id, start, n): events of a user no further apart than gap."""
    return events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")
