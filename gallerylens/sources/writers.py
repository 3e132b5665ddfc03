"""Writers."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F


def triples(edges: DataFrame, path: str) -> None:
    edges.select("head", "rel", "tail").write.mode("overwrite").option("sep", "\t").csv(path)


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def fragments(df: DataFrame, path: str, shards: int, key: str = "id") -> None:
    """Parquet in shards by id; a rerun replaces only the shards that it writes."""
    sharded = df.withColumn("shard", F.pmod(F.xxhash64(key), F.lit(shards)).cast("int"))
    sharded.repartition("shard").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)


def bucketed(df: DataFrame, table: str, buckets: int, key: str = "doc_id") -> None:
    """A table whose rows of one key lie in one bucket, so that joins on it need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def upload(df: DataFrame, send: Callable[[list[tuple]], None], batch: int = 512, attempts: int = 5, delay: float = 0.5) -> None:
    """Rows in batches to send, which must be idempotent by id: a batch is tried again up to attempts times, each after twice the delay, a task by Spark."""

    def run(rows) -> None:
        held: list[tuple] = []

        def flush() -> None:
            for n in range(attempts):
                try:
                    return send(held)
                except Exception:
                    if n == attempts - 1:
                        raise
                    time.sleep(delay * 2**n)

        for row in rows:
            held.append(tuple(row))
            if len(held) >= batch:
                flush()
                held.clear()
        if held:
            flush()

    df.foreachPartition(run)
