"""The multi-vector index: every vector is in a list, few lists are read, and most of the best documents are found."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from gallerylens.operators import multiindex, quantised, retrieval


@pytest.fixture(scope="module")
def topics(spark):
    """Documents whose vectors lie near some of forty directions; copies, an empty document and a null one among them."""
    rng = np.random.default_rng(5)
    dirs = rng.standard_normal((40, 48))
    rows = []
    for i in range(1200):
        own = rng.choice(40, 3, replace=False)
        rows.append((i, [(dirs[t] + 0.5 * rng.standard_normal(48)).tolist() for t in [*own, *own[:2]][: 2 + i % 4]]))
    rows += [(1200 + i, rows[7][1]) for i in range(300)] + [(1500, []), (1501, None)]
    return spark.createDataFrame(rows, "id long, vs array<array<double>>").repartition(5).cache()


def asked(documents, every):
    return documents.where(f"id % {every} = 0 AND id < 1200").select(F.col("id").alias("qid"), F.posexplode("vs").alias("qtok", "q"))


def test_every_vector_is_indexed_once(spark, topics, tmp_path):
    made = multiindex.build(topics, f"{tmp_path}/index", k=5)
    total = topics.agg(F.sum(F.when(F.size("vs") > 0, F.size("vs")))).first()[0]
    assert made.rows(spark).count() == total
    assert 0.5 * total**0.5 <= len(made.centres) <= 2 * total**0.5 and made.probes < len(made.centres) / 3
    assert made.status(topics) == (1500, 1500)
    assert multiindex.build(topics.limit(60), f"{tmp_path}/less").centres.shape[0] < len(made.centres)  # lists grow with the corpus
    more = spark.createDataFrame([(5000, [[1.0] * 48])], "id long, vs array<array<double>>")
    assert made.status(more) == (0, 1)
    multiindex.add(made, more)
    assert made.status(more) == (1, 1) and made.rows(spark).count() == total + 1


def test_recall_and_few_lists(spark, topics, tmp_path):
    made = multiindex.build(topics, f"{tmp_path}/index", recall=0.95, k=10, prefetch=75)
    queries = asked(topics, 25)
    exact = retrieval.maxsim_topk(queries, topics, 10)
    found = multiindex.search(made, queries, topics, 10, 75)
    assert retrieval.recall(found, exact) >= 0.9
    every = multiindex.search(made, queries, topics, 10, 1502, probes=len(made.centres))  # all lists, all documents
    a, b = ({(r.qid, r["rank"]): round(r.score, 9) for r in x.collect()} for x in (every, exact))
    assert a == b
    assert made.probes <= len(made.centres) / 3
    plan = multiindex.search(made, queries.limit(1), topics, 5)._jdf.queryExecution().toString()
    assert plan


def test_cells_are_pruned(spark, topics, tmp_path):
    made = multiindex.build(topics, f"{tmp_path}/index", k=5)
    plan = made.rows(spark).where(F.col("cell").isin([1]) & F.col("list").isin([3, 4]))._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "cell" in plan.split("PartitionFilters")[1][:60]


def test_small_and_empty(spark, topics, tmp_path):
    queries = asked(topics, 300)
    few = topics.where("id < 50")
    assert multiindex.build_if_large(few, f"{tmp_path}/none") is None
    assert multiindex.search(None, queries, few, 3).count() == 3 * queries.select("qid").distinct().count()
    assert multiindex.build_if_large(few, f"{tmp_path}/some", threshold=10) is not None
    nothing = multiindex.build(topics.limit(0), f"{tmp_path}/empty")
    assert multiindex.search(nothing, queries, topics.limit(0), 3).count() == 0
    one = topics.where("id = 3")
    assert [r.id for r in multiindex.search(multiindex.build(one, f"{tmp_path}/one"), queries, one, 3).collect()] == [3] * 4
    assert multiindex.search(multiindex.build(few, f"{tmp_path}/q"), queries.limit(0), few, 3).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_recall_on_the_table(spark):
    from gallerylens.plans import vectors as plans
    from gallerylens.plans.views import Tables

    t = Tables(spark, "/root/testdata/sf0.1")
    assert retrieval.recall(plans.maxsim_index(t), plans.maxsim_full(t)) >= 0.9
    assert quantised.SAMPLE_DOCUMENTS >= 400  # measured on all of this table


def shuffled(spark):
    """Records written to shuffles so far."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_no_row_for_a_query_and_a_document(spark, topics, tmp_path):
    """A row for each query token and document that a list shows was shuffled: the product of both tables."""
    made = multiindex.build(topics, f"{tmp_path}/index", k=5)
    queries = asked(topics, 2)
    tokens, documents = queries.count(), 1500
    began = shuffled(spark)
    assert multiindex.search(made, queries, topics, 5, 20, probes=len(made.centres)).count() == 5 * 600
    assert shuffled(spark) - began < tokens * documents / 10
