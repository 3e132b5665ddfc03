"""Codes against the vectors they stand for, and two stages on codes against the exact search."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from gallerylens.operators import quantised, retrieval


@pytest.mark.parametrize("dim", [1, 63, 64, 65, 128, 200])
def test_codes(dim):
    v = np.random.default_rng(dim).standard_normal((40, dim))
    v[3] = 0
    for planes in (1, 2, 4):
        bits, scales = quantised.encode(v, planes)
        assert bits.shape == (40, planes, -(-dim // 64))
        back = quantised.decode(bits, scales, dim)
        assert np.allclose(quantised.dots((bits, scales), (bits, scales), dim), back @ back.T)
        if planes == 1:
            assert ((back > 0) == (v > 0))[np.abs(v).sum(axis=1) > 0].all()
    if dim > 60:
        errors = [np.linalg.norm(quantised.decode(*quantised.encode(v, p), dim) - v) for p in (1, 2, 3, 4, 6)]
        assert all(b < 0.8 * a for a, b in zip(errors, errors[1:], strict=False))


def made(spark, n=120, dim=96, seed=1):
    """Documents of one to six vectors in topics, with repeated vectors, an empty document and a null one."""
    rng = np.random.default_rng(seed)
    topics = rng.standard_normal((12, dim))
    rows = [(i, [(topics[i % 12] + 0.6 * rng.standard_normal(dim)).tolist() for _ in range(1 + i % 6)]) for i in range(n)]
    rows += [(n, rows[0][1]), (n + 1, []), (n + 2, None)]
    return rows, spark.createDataFrame(rows, "id long, vs array<array<double>>").repartition(4)


def brute(rows, asked, k, planes, score):
    out = {}
    for q, tokens in asked:
        found = sorted((-score(np.array(tokens), np.array(vs)), i) for i, vs in rows if vs)
        out[q] = [(i, -s) for s, i in found[:k]]
    return out


def got(df):
    out = {}
    for r in df.orderBy("qid", "rank").collect():
        out.setdefault(r.qid, []).append((r.id, r.score))
    return out


def same(a, b):
    return a.keys() == b.keys() and all([i for i, _ in a[q]] == [i for i, _ in b[q]] and np.allclose([s for _, s in a[q]], [s for _, s in b[q]]) for q in a)


@pytest.mark.parametrize("planes", [1, 3])
def test_stages(spark, monkeypatch, planes):
    monkeypatch.setattr(quantised, "CELLS", 50)
    rows, documents = made(spark)
    asked = [(i, rows[i][1]) for i in range(0, 120, 17)]
    queries = spark.createDataFrame([(q, t, v) for q, vs in asked for t, v in enumerate(vs)], "qid long, qtok long, q array<double>")
    back = lambda v: quantised.decode(*quantised.encode(v, planes), v.shape[1])
    coarse = lambda q, d: (back(q) @ back(d).T).max(axis=1).sum()
    exact = lambda q, d: (q @ d.T).max(axis=1).sum()
    coded = quantised.codes(documents, planes)
    first = brute(rows, asked, 14, planes, coarse)
    assert same(got(quantised.candidates(queries, coded, 14, planes)), first)
    want = {q: sorted(((i, exact(np.array(dict(asked)[q]), np.array(dict(rows)[i]))) for i, _ in found), key=lambda x: (-round(x[1], 9), x[0]))[:5] for q, found in first.items()}
    assert same(got(quantised.two_stage(queries, documents, coded, 14, 5, planes)), want)
    assert same(got(quantised.two_stage(queries, documents, coded, 14, 5, planes, full=coded, oversample=2.8)), want)
    assert quantised.two_stage(queries.limit(0), documents, coded, 14, 5, planes).count() == 0
    assert quantised.candidates(queries, quantised.codes(documents.limit(0), planes), 3, planes).count() == 0


def test_planes_are_measured(spark):
    """As many as a recall needs: fewer where topics are far apart than in noise."""
    noise = spark.createDataFrame([(i, [v.tolist() for v in np.random.default_rng(i).standard_normal((3, 64))]) for i in range(400)], "id long, vs array<array<double>>")
    least = quantised.planes_for(noise, 0.9, 0.05, 10)
    held = [np.array(r.vs) for r in noise.collect()]
    assert 2 <= least <= 6 and (quantised.places(held, least, 10) <= 0.05).mean() >= 0.85
    assert quantised.planes_for(noise, 0.1, 0.5, 10) == 1
    assert quantised.planes_for(noise.limit(1), 0.9, 0.05, 10) == 1


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_recall_on_the_tables(spark):
    """Recall of 0.9 or more with under a twentieth of the table as candidates."""
    from gallerylens.plans import vectors as plans
    from gallerylens.plans.views import Tables

    t = Tables(spark, "/root/testdata/sf0.1")
    queries, documents = plans._mv(t)
    n = documents.count()
    exact = retrieval.maxsim_topk(queries, documents, 10)
    share = int(0.05 * n) - 1
    planes = quantised.planes_for(documents, 0.95, share / n, 10)
    assert retrieval.recall(quantised.two_stage(queries, documents, quantised.codes(documents, planes), share, 10, planes), exact) >= 0.9
    assert retrieval.recall(plans.two_stage_quantised(t), plans.maxsim_full(t)) >= 0.9
    assert retrieval.recall(plans.binary_quant_topk(t), plans.knn_cosine_topk(t)) >= 0.9


def test_candidates_are_those_of_counted_bits(spark):
    """Only pairs near to the best are counted; scores and the order of copies are those of all pairs counted."""
    rng = np.random.default_rng(8)
    own = rng.normal(size=(30, 3, 70)) * 1000
    documents = spark.createDataFrame([(i, own[i % 30].tolist()) for i in range(90)], "id long, vs array<array<double>>").repartition(3)
    asked = spark.createDataFrame([(i, k, v.tolist()) for i in range(30) for k, v in enumerate(own[i])], "qid long, qtok long, q array<double>")
    got = {(r.qid, r["rank"]): (r.id, r.score) for r in quantised.candidates(asked, quantised.codes(documents, 2), 7, 2).collect()}
    coded = quantised.encode(own.reshape(-1, 70), 2)
    each = np.add.reduceat(np.maximum.reduceat(quantised.dots(coded, coded, 70), np.arange(0, 90, 3), axis=1), np.arange(0, 90, 3), axis=0)
    for q in range(30):
        want = sorted((-each[q, i % 30], i) for i in range(90))[:7]
        assert [got[q, n + 1] for n in range(7)] == [(i, -s) for s, i in want]
