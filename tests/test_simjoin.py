"""The similarity join against all pairs."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from gallerylens.operators import simjoin


def tables(spark, seed=3, dim=40):
    rng = np.random.default_rng(seed)
    right = rng.standard_normal((900, dim))
    left = right[rng.integers(0, 900, 500)] + 0.7 * rng.standard_normal((500, dim))
    lefts = [(i, v.tolist()) for i, v in enumerate(left)] + [(600, left[0].tolist()), (601, [0.0] * dim), (602, [])]
    rights = [(1000 + i, v.tolist()) for i, v in enumerate(right)] + [(5, right[3].tolist())] + [(3000 + i, right[7].tolist()) for i in range(400)]
    kind = "id long, v array<double>"
    return lefts, rights, spark.createDataFrame(lefts, kind).repartition(4), spark.createDataFrame(rights, kind).repartition(4)


def exact(lefts, rights):
    unit = lambda rows: np.array([v for _, v in rows]) / np.linalg.norm([v for _, v in rows], axis=1, keepdims=True)
    some = [r for r in lefts if r[1] and any(r[1])]
    scores = unit(some) @ unit(rights).T
    return {i: min((-round(float(s), 9), rights[k][0]) for k, s in enumerate(row)) for (i, _), row in zip(some, scores, strict=True)}


@pytest.mark.parametrize("block", [2048, 7])
def test_recall_and_scores(spark, monkeypatch, block):
    monkeypatch.setattr(simjoin, "BLOCK", block)  # small blocks: every bucket is dealt out
    lefts, rights, a, b = tables(spark)
    want = exact(lefts, rights)
    got = {r.id: (-round(r.score, 9), r.partner) for r in simjoin.nearest_partners(a, b).collect()}
    assert set(got) <= set(want) and sum(got.get(i) == w for i, w in want.items()) >= 0.9 * len(want)
    score = dict(rights)
    for i, (s, partner) in got.items():
        x, y = np.array(dict(lefts)[i]), np.array(score[partner])
        assert -s == pytest.approx(x @ y / np.linalg.norm(x) / np.linalg.norm(y), abs=1e-8)
    assert got[600] == got[0] and not {601, 602} & set(got)


def test_equal_vectors_meet_once_by_the_smallest_id(spark):
    lefts, rights, a, b = tables(spark)
    mine = spark.createDataFrame([(1, rights[3][1]), (2, rights[7][1])], "id long, v array<double>")
    got = {r.id: r.partner for r in simjoin.nearest_partners(mine, b, bands=12).collect()}
    assert got == {1: 5, 2: 1007}
    assert simjoin.nearest_partners(a, b, least=1.1).count() == 0
    assert simjoin.nearest_partners(a.limit(0), b).count() == 0 and simjoin.nearest_partners(a, b.limit(0)).count() == 0


def test_no_cross_join(spark):
    _, _, a, b = tables(spark)
    plan = simjoin.nearest_partners(a, b, bands=4)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_bands_follow_from_the_recall():
    rng = np.random.default_rng(0)
    right = rng.standard_normal((400, 32))
    near, far = right[:100] + 0.2 * rng.standard_normal((100, 32)), rng.standard_normal((100, 32))
    few, many = simjoin.bands_for(near, right, 5, 0.95), simjoin.bands_for(far, right, 5, 0.95)
    assert few < 8 < many and simjoin.bands_for(near, right, 5, 0.5) <= few


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_recall_on_the_table(spark):
    from gallerylens.plans import vectors as plans
    from gallerylens.plans.views import Tables

    t = Tables(spark, "/root/testdata/sf0.1")
    rows = t.vec().select("vec_id", "v").collect()
    want = exact([(r.vec_id, r.v) for r in rows if r.vec_id % 2 == 0], [(r.vec_id, r.v) for r in rows if r.vec_id % 2])
    got = {r.image: r.paragraph for r in plans.sim_join_best(t).collect()}
    assert sum(got.get(i) == p for i, (_, p) in want.items()) >= 0.9 * len(want)
