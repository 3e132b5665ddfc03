"""Gradients by differences, links by brute force, and held-out tails that one space for all relations cannot hold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gallerylens.operators import graph, transr


def test_gradients():
    rng = np.random.default_rng(0)
    m, r = rng.normal(size=(3, 4)), rng.normal(size=3)
    ends = [rng.normal(size=(6, 4)) for _ in range(3)]
    loss, wrong, of_h, of_t, of_o, of_r, of_m = transr.gradients(m, r, *ends, 1.0)
    assert 0 < len(wrong) < 6

    def plain(m, r, ends):
        return sum(max(0, 1 + np.sum((m @ (h - t) + r) ** 2) - np.sum((m @ (h - o) + r) ** 2)) for h, t, o in zip(*ends, strict=True))

    assert loss == pytest.approx(plain(m, r, ends))
    slope = lambda make: (plain(*make(1e-6)) - plain(*make(-1e-6))) / 4e-6
    moved = lambda x, at, e: x + e * (np.arange(x.size).reshape(x.shape) == at)
    assert np.allclose(of_r, [slope(lambda e, i=i: (m, moved(r, i, e), ends)) for i in range(3)], atol=1e-5)
    assert np.allclose(of_m.ravel(), [slope(lambda e, i=i: (moved(m, i, e), r, ends)) for i in range(12)], atol=1e-5)
    for k, g in enumerate((of_h, of_t, of_o)):
        full = np.zeros((6, 4))
        full[wrong] = g
        assert np.allclose(full.ravel(), [slope(lambda e, i=i, k=k: (m, r, [moved(x, i, e) if j == k else x for j, x in enumerate(ends)])) for i in range(24)], atol=1e-5)


@pytest.mark.parametrize("block", [1 << 22, 30])
def test_predicted_links(spark, monkeypatch, block):
    from gallerylens.operators import retrieval

    monkeypatch.setattr(retrieval, "BLOCK_VALUES", block)  # candidates in many blocks
    rng = np.random.default_rng(4)
    heads, cands = rng.normal(size=(40, 5)), rng.normal(size=(30, 5))
    cands[7] = cands[3]
    r, m = rng.normal(size=4), rng.normal(size=(4, 5))
    a = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(heads)], "id long, v array<double>").repartition(3)
    b = spark.createDataFrame([(f"c{i:02}", v.tolist()) for i, v in enumerate(cands)], "cid string, c array<double>")
    for rel, proj in ((None, None), (r, m), (r, np.eye(4, 5))):
        x = heads if proj is None else heads @ proj.T + rel
        y = cands if proj is None else cands @ proj.T
        far = np.linalg.norm(x[:, None] - y[None], axis=2)
        got = {q.id: (q.best, -q.score) for q in graph.predict_link(a, b, rel, proj).collect()}
        assert all(got[i][0] == f"c{far[i].round(12).argmin():02}" and got[i][1] == pytest.approx(far[i].min()) for i in range(40))
    assert graph.predict_link(a, b.limit(0)).count() == 0 and graph.predict_link(a.limit(0), b).count() == 0


def held_out(spark):
    """Works of twelve groups; by two relations they lead to three and to four ends, so that either groups them otherwise."""
    rows = [(f"w{i}", "style", f"s{i % 3}") for i in range(96)] + [(f"w{i}", "genre", f"g{i % 4}") for i in range(96)] + [(f"w{i}", "near", f"w{(i + 12) % 96}") for i in range(96)]
    out = [t for t in rows if int(t[0][1:]) % 6 == 5 and t[1] == "style"]
    kind = "head string, rel string, tail string"
    return spark.createDataFrame([t for t in rows if t not in out], kind), spark.createDataFrame(out, kind)


def test_training(spark):
    train, test = held_out(spark)
    model = transr.train(train, dim=8, rounds=14, rate=0.4)
    assert len(model.losses) == 14 and model.losses[-1] < 0.5 * model.losses[0]
    entities, relations = graph.train_links(train, dim=8, rounds=14, rate=0.4)
    moved = np.array({r.rel: r.v for r in relations.collect()}["style"])
    ends = spark.createDataFrame([(f"s{k}",) for k in range(3)], "id string")
    heads = test.select(F.col("head").alias("id"))
    truth = {r.head: r.tail for r in test.collect()}
    hits = lambda df: sum(truth[r.id] == r.best for r in df.collect())
    plain = graph.predict_link(heads.join(entities, "id"), entities.join(ends, "id").select(F.col("id").alias("cid"), F.col("v").alias("c")), moved)
    assert hits(transr.predict(model, heads, "style", ends)) > hits(plain)


def test_pinned_repeated_and_empty(spark):
    train, _ = held_out(spark)
    pinned = spark.createDataFrame([("s0", [3.0] * 8)], "id string, p array<double>")
    model = transr.train(train.unionAll(train), dim=8, seen=5, rounds=1, pinned=pinned)
    v = {r.id: np.array(r.v) for r in model.entities.collect()}
    assert v["s0"].tolist() == [3.0] * 8 and all(abs(np.linalg.norm(x) - 1) < 1e-9 for i, x in v.items() if i != "s0")
    assert {k: (r.shape, m.shape) for k, (r, m) in model.relations.items()} == dict.fromkeys(["genre", "near", "style"], ((5,), (5, 8)))
    none = transr.train(train.limit(0))
    assert none.entities.count() == 0 and none.relations == {} and none.losses == []


@pytest.mark.parametrize("kind", ["links", "projected"])
def test_a_round_writes_entities_alone(spark, kind):
    """A round's gradients, rows for each triple, were written with their vectors before they were summed."""
    df = spark.createDataFrame([(f"w{i}", f"r{j}", f"t{(i + j) % 7}") for i in range(1000) for j in range(3)], "head string, rel string, tail string")
    sc = spark.sparkContext

    def written():
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return sum(stages.apply(i).outputRecords() for i in range(stages.size()))

    began = written()
    graph.train_links(df, dim=4, rounds=1) if kind == "links" else transr.train(df, dim=4, rounds=1)
    # triples, tails twice, the hottest, entities before and after the round, relations
    assert written() - began < 3000 + 2 * 1007 + 100
