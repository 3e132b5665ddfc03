"""Session defaults."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession


def session(app: str = "gallerylens", cpus: int | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """A local session; on a cluster the submitted configuration decides and this only sets what the operators rely on.

    The session's Python workers get this package; to a session made otherwise give it by `ship`.
    """
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = SparkSession.builder.appName(app)
    submitted = "--master" in os.environ.get("PYSPARK_SUBMIT_ARGS", "") or {"SPARK_REMOTE", "PYSPARK_GATEWAY_PORT"} & os.environ.keys() or SparkContext._active_spark_context
    if not submitted and "spark.master" not in conf:
        builder = builder.master(f"local[{cpus}]")
    own = {
        "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": str(partitions or cpus), "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
    }
    spark = builder.config(map=own | conf).getOrCreate()
    ship(spark)
    return spark


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the session's Python workers, once, so that they can import it wherever they start."""
    if spark.sparkContext.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="ship-")) / f"{root.name}.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(path))
    _SHIPPED.add(spark.sparkContext.applicationId)


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """query, with this package sent first."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run
