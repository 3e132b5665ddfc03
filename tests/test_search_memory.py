import resource

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gallerylens.operators import retrieval


def peak_mb(spark):
    def run(batches):
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10])], ["mb"])

    return spark.range(8, numPartitions=8).mapInArrow(run, "mb long").agg(F.max("mb")).first()[0]


def vectors(spark, n, d=4):
    rng = np.random.default_rng(1)
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(n, d)))], "id long, v array<double>").coalesce(1)


def test_a_search_holds_tiles_of_the_scores(spark):
    """All queries' scores for a batch of 10,000 rows were held at once."""
    corpus = vectors(spark, 10_000)
    asked = corpus.where("id < 6000").select(F.col("id").alias("qid"), F.col("v").alias("q"))
    assert retrieval.knn(asked, corpus, 3).count() == 18_000
    assert peak_mb(spark) < 450


def test_copies_rank_by_id(spark):
    rows = [(i, [float(i % 5 + 1), float(i % 3 - 1), 0.3]) for i in range(2500)]
    corpus = spark.createDataFrame(rows, "id long, v array<double>")
    asked = corpus.where("id in (0, 7)").select(F.col("id").alias("qid"), F.col("v").alias("q"))
    got = retrieval.knn(asked, corpus, 3).orderBy("qid", "rank").collect()
    assert [(r.qid, r.id) for r in got] == [(0, 15), (0, 30), (0, 45), (7, 22), (7, 37), (7, 52)]


def test_tiles_are_whole_queries_and_the_best_are_exact():
    rng = np.random.default_rng(2)
    first = np.array([0, 3, 4, 9, 20])
    tiles = list(retrieval.query_tiles(first, 22, 5))
    assert [t[0] for t in tiles] == [(0, 2), (2, 3), (3, 4), (4, 5)] and tiles[-1][1] == (20, 22)
    scores = rng.integers(0, 6, (9, 200)).astype(float)
    ids = rng.permutation(200)
    best = retrieval.Best(9, 7)
    for a in range(0, 9, 4):
        for c in range(0, 200, 33):
            best.add(a, scores[a : a + 4, c : c + 33], ids[c : c + 33])
    for q in range(9):
        want = sorted(zip(-scores[q], ids, strict=True))[:7]
        assert [(-s, i) for s, i in zip(best.scores[q], best.ids[q], strict=True)] == [(s, i) for s, i in want]


def test_runs_of_documents_are_bounded_and_whole(spark):
    """A batch of 10,000 documents became Python lists of all its values."""
    lengths = np.random.default_rng(3).integers(0, 9, 4000)
    values = np.arange(lengths.sum() * 64, dtype=float)
    vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, 64), pa.int32()), pa.array(values))
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), vectors)
    runs = list(retrieval._document_runs(pa.RecordBatch.from_arrays([pa.array(range(4000)), lists], ["id", "vs"]), "vs"))
    assert max(flat.size for _, _, flat in runs) <= retrieval.POOLED_VALUES
    assert np.concatenate([flat for _, _, flat in runs]).ravel().tolist() == values.tolist()
    assert np.concatenate([n for _, n, _ in runs]).tolist() == lengths.tolist()
    assert [i for part, _, _ in runs for i in part.column("id").to_pylist()] == list(range(4000))


def test_copies_of_documents_rank_by_id(spark):
    """Scores were summed in the order in which a shuffle brought a query's tokens, so that copies differed in their last bits."""
    rng = np.random.default_rng(4)
    own = rng.normal(size=(10, 5, 16)).tolist()
    documents = spark.createDataFrame([(i, own[i % 10]) for i in range(500)], "id long, vs array<array<double>>").repartition(6)
    asked = spark.createDataFrame([(i, k, v) for i in range(10) for k, v in enumerate(own[i])], "qid long, qtok long, q array<double>")
    got = retrieval.two_stage(asked, documents, retrieval.pooled(documents, 1, 1, 3), 60, 40)
    assert {(r.qid, r["rank"]): r.id for r in got.collect()} == {(q, n + 1): q + 10 * n for q in range(10) for n in range(40)}
