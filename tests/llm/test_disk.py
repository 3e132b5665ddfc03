"""What the operators leave on disk while they run."""

import os

from gallerylens.llm import common, components


def shuffled(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for folder in folders for _, _, files in os.walk(folder.getPath()) for f in files if f.startswith("shuffle_")}


def test_stored_leaves_no_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 7 AS k", "id").groupBy("k").count()
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    had, before = shuffled(spark), spark.conf.get(key, "false")
    for _ in range(2):  # the same frame again too
        out = common.stored(df, "counts")
        assert not shuffled(spark) - had
        assert sum(r["count"] for r in out.collect()) == 1000
    assert spark.conf.get(key, "false") == before


def test_rounds_of_components_go(spark):
    """A path of 60 nodes takes several rounds, of which one table is left."""
    mark = common.written()
    found = components.connected_components(spark.range(60).selectExpr("id AS a", "id + 1 AS b"))
    assert common.written() - mark == 1
    assert {(r.node, r.component) for r in found.collect()} == {(n, 0) for n in range(61)}
