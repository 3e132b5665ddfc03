"""The forward pass in blocks against one that goes token by token, head by head."""

import math

import numpy as np
import pytest

from gallerylens.operators import encoder


def plain(net, side, tokens):
    """All tokens after all layers, by loops over tokens and heads."""
    w, x, k = net.weights, [np.array(t, float) for t in tokens], 0
    while f"{side}_encoder.layers.{k}.linear1.weight" in w:
        own = {n.split(f"layers.{k}.", 1)[1]: v for n, v in w.items() if n.startswith(f"{side}_encoder.layers.{k}.")}
        d = len(x[0])
        size = d // net.heads
        qkv = [own["self_attn.in_proj_weight"] @ t + own["self_attn.in_proj_bias"] for t in x]
        after = []
        for i, t in enumerate(x):
            heads = []
            for h in range(net.heads):
                cut = lambda y, part: y[part * d + h * size : part * d + (h + 1) * size]  # noqa: B023, E731
                e = [math.exp(float(cut(qkv[i], 0) @ cut(y, 1)) / math.sqrt(size)) for y in qkv]
                heads.append(sum(a / sum(e) * cut(y, 2) for a, y in zip(e, qkv, strict=True)))
            t = t + own["self_attn.out_proj.weight"] @ np.concatenate(heads) + own["self_attn.out_proj.bias"]
            t = (t - t.mean()) / math.sqrt(t.var() + 1e-5) * own["norm1.weight"] + own["norm1.bias"]
            f = own["linear1.weight"] @ t + own["linear1.bias"]
            f = np.array([max(v, 0) if net.activation == "relu" else v * (1 + math.erf(v / math.sqrt(2))) / 2 for v in f])
            t = t + own["linear2.weight"] @ f + own["linear2.bias"]
            after.append((t - t.mean()) / math.sqrt(t.var() + 1e-5) * own["norm2.weight"] + own["norm2.bias"])
        x, k = after, k + 1
    return [w[f"{side}_projection.weight"] @ t for t in x]


@pytest.mark.parametrize("activation", ["relu", "gelu"])
def test_forward_pass(monkeypatch, activation):
    net = encoder.random_network(16, 3, layers=2, heads=4, inner=24, out=20)
    net.activation = activation
    rng = np.random.default_rng(1)
    found = [rng.standard_normal((n, 16)) for n in (4, 1, 7, 0, 4, 12)]
    want = np.array([plain(net, "visual", [*net.weights["task_embeddings_visual"], *v])[:3] for v in found])
    for block in (1 << 20, 500, 1):  # all at once, a few, one by one
        monkeypatch.setattr(encoder, "BLOCK_VALUES", block)
        assert np.allclose(net.visual(found), want, atol=2e-6)
        tasks = [0, 2, 1, 1, 0, 2]
        texts = np.array([plain(net, "text", [net.weights["task_embeddings_text"][t], *v])[0] for t, v in zip(tasks, found, strict=True)])
        assert np.allclose(net.text(found, tasks), texts, atol=2e-6)
    assert net.text([], []).shape[0] == 0 and len(net.visual([])) == 0


def test_tables(spark, tmp_path):
    net = encoder.random_network(8, 2, heads=2, inner=10, out=6)
    np.savez(tmp_path / "weights.npz", **net.weights)
    loaded = encoder.load(spark, f"{tmp_path}/weights.npz", 2)
    assert all(np.array_equal(loaded.weights[k], v) for k, v in net.weights.items())
    rng = np.random.default_rng(2)
    vs = [rng.standard_normal((n, 8)) for n in (3, 1, 5)]
    images = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vs)] + [(3, []), (4, None), (0, vs[0].tolist())], "id long, vs array<array<double>>").repartition(3)
    got = encoder.embed_images(images, loaded)
    want = net.visual([*vs, np.zeros((0, 8))])
    rows = got.collect()
    assert len(rows) == 12 and all(np.allclose(r.v, want[min(r.id, 3), r.task]) for r in rows)
    labels = spark.createDataFrame([(t, f"l{i}", vs[i].tolist()) for t in (0, 1) for i in range(3)] + [(0, "again", vs[1].tolist())], "task int, label string, vs array<array<double>>")
    named = encoder.embed_labels(labels, loaded)
    text = {(r.task, r.label): np.array(r.v) for r in named.collect()}
    assert all(np.allclose(v, net.text([vs[1 if n == "again" else int(n[1])]], [t])[0]) for (t, n), v in text.items())
    scores = {}
    for r in encoder.label_scores(got, named, k=2).collect():
        scores.setdefault((r.id, r.task), {})[r["rank"]] = (r.label, r.score)
    for (i, t), own in scores.items():
        v = want[min(i, 3), t]
        logit = {n: 10 * (v @ y) / np.linalg.norm(v) / np.linalg.norm(y) - 10 for (s, n), y in text.items() if s == t}
        best = sorted(logit, key=lambda n: (-round(logit[n], 9), n))[:2]
        assert [own[k][0] for k in (1, 2)] == best and own[1][1] == pytest.approx(1 / (1 + math.exp(-logit[best[0]])))
    assert encoder.label_scores(got, named, least=2).count() == 0 and encoder.embed_images(images.limit(0), net).count() == 0
    with pytest.raises(ValueError):
        encoder.label_scores(got, named.limit(0).unionAll(spark.range(100_001).selectExpr("0 AS task", "string(id) AS label", "array(1D) AS v")))
