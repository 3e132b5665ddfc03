"""Uploads: nothing half, nothing twice, whatever fails."""

import os
from collections import Counter

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gallerylens.sources import uploads


def flaky(*args, **named):
    """A store whose class goes to the workers as it is."""

    class Flaky(uploads.FolderStore):
        """Fails the first times that a batch is staged, or always for a partition."""

        def __init__(self, path, times=0, never=None):
            super().__init__(path)
            self.times, self.never = times, never

        def stage(self, run, batch, rows):
            part, mark = batch.split("-")[0], f"{self.path}/tried-{run}-{batch}"
            if part == self.never and batch.endswith("-1"):
                raise OSError("down")
            tried = os.path.getsize(mark) if os.path.exists(mark) else 0
            os.makedirs(self.path, exist_ok=True)
            with open(mark, "a") as file:
                file.write(".")
            if tried < self.times:
                raise OSError("busy")
            super().stage(run, batch, rows)

    return Flaky(*args, **named)


def rows(spark):
    return spark.range(1000).select("id", F.array(F.lit(1.5), F.col("id") * 2.0).alias("v"), F.struct(F.lit("a").alias("x")).alias("s")).repartition(4)


def ids(store):
    return Counter(r["id"] for r in store.rows())


def test_all_rows_once(spark, tmp_path):
    store = flaky(f"{tmp_path}/store", times=2)
    uploads.upload(rows(spark), store, "one", batch=70, delay=0.001)
    assert ids(store) == Counter(range(1000)) and store.rows()[0].keys() == {"id", "v", "s"}
    uploads.upload(rows(spark), store, "one", batch=70)  # again: it is there
    assert ids(store) == Counter(range(1000))
    uploads.upload(rows(spark).where("id < 10"), store, "two")
    assert ids(store) == Counter(range(1000)) + Counter(range(10))


def test_a_failed_run_leaves_nothing(spark, tmp_path):
    store = flaky(f"{tmp_path}/store", never="2")
    with pytest.raises(PySparkException):
        uploads.upload(rows(spark), store, "run", batch=50, attempts=2, delay=0.001)
    assert store.rows() == [] and not store.published("run")
    store.never = None
    uploads.upload(rows(spark), store, "run", batch=50)
    assert ids(store) == Counter(range(1000))
    named = sum(len(fs) for _, _, fs in os.walk(f"{tmp_path}/store/staged/run"))
    assert named == sum(-(-n // 50) for n in Counter(r.p for r in rows(spark).select(F.spark_partition_id().alias("p")).collect()).values())


def test_empty(spark, tmp_path):
    store = uploads.FolderStore(f"{tmp_path}/store")
    uploads.upload(rows(spark).where("id < 0"), store, "none")
    assert store.rows() == [] and store.published("none")
