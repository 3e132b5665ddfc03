"""The search against scoring every document, and the bisection by what it is for."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from gallerylens.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def cut(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("aZ09 _-\n\x85\xa0é"))))
def test_terms(text):
    assert [t.decode() for t in lexical.terms(text.encode())] == cut(text)


def brute(rows, items, k):
    docs = [(i, Counter(cut(t))) for i, t in rows]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n, total = len(docs), sum(x[2] for x in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        own = Counter(cut(text))
        found = []
        for i, c, length in docs:
            m = 100 - 75 + 75 * length * n // total
            score = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t, q in own.items() if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(found)[:k], 1)]
    return out


def asked(rows):
    rng = random.Random(9)
    texts = [t for _, t in rows if t]
    some = [(i, " ".join(cut(rng.choice(texts))[: rng.randint(1, 40)])) for i in range(25)]
    return [*some, (25, None), (26, ""), (27, "never said"), (28, "the the THE of river"), (None, "stone Über 日本"), (28, "mit")]


@pytest.mark.parametrize("small", [False, True])
def test_search(spark, docs, rows, monkeypatch, small):
    if small:  # many blocks, clusters and rounds of items
        for name, value in {"BLOCK_POSTINGS": 60, "BLOCK_DOCS": 9, "CLUSTER": 2, "ITEMS": 7, "SAMPLE": 40}.items():
            monkeypatch.setattr(lexical, name, value)
    items = asked(rows)
    every = [*rows, (None, "no id"), (None, "stone"), (-5, "stone")]
    table = docs.select("doc_id", "text").unionAll(spark.createDataFrame([(None, "stone"), (-5, "stone")], "doc_id long, text string"))
    got = lexical.ranked(table, spark.createDataFrame(items, "item_id long, text string"), 10)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, got.collect())) == Counter(brute(every, items, 10))


def test_ties_reach_over_blocks(spark, monkeypatch):
    """Copies of one text in many blocks: the smallest ids win, whatever block they lie in."""
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 5)
    rng = random.Random(2)
    rows = [(i, "same words here") for i in rng.sample(range(1000), 90)] + [(2000 + i, f"other {i}") for i in range(60)]
    got = lexical.ranked(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame([(1, "same here")], "item_id long, text string"), 10)
    assert [r.doc_id for r in got.orderBy("rank").collect()] == sorted(i for i, t in rows if t[0] == "s")[:10]


def test_empty(spark, empty):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical.ranked(empty, items).collect() == []
    full = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert lexical.ranked(full, items.limit(0)).collect() == []
    assert lexical.ranked(full.where("doc_id = 2"), items.limit(0)).collect() == []


def cost(docs, leaf):
    """Bits of the gaps between documents that hold a term, in the order of leaves."""
    order = np.argsort(leaf, kind="stable")
    place, gaps = {int(d): i for i, d in enumerate(order)}, 0.0
    holds = {}
    for d, own in enumerate(docs):
        for t in own:
            holds.setdefault(t, []).append(place[d])
    for own in holds.values():
        own = sorted(own)
        gaps += sum(math.log2(b - a + 1) for a, b in zip([-1, *own], own))
    return gaps


def test_bisection_brings_like_documents_together():
    rng = random.Random(1)
    topics = [[f"t{k}w{i}" for i in range(30)] for k in range(8)]
    docs = [{*rng.sample(topics[d % 8], 12), *rng.sample([f"c{i}" for i in range(40)], 6)} for d in range(256)]
    ids = {}
    doc_of = np.repeat(np.arange(256), [len(d) for d in docs])
    term_of = np.array([ids.setdefault(t, len(ids)) for d in docs for t in sorted(d)])
    leaf = lexical.bisect(doc_of, term_of, 256, leaf=32)
    assert set(Counter(leaf.tolist()).values()) == {32}
    assert cost(docs, leaf) < 0.8 * cost(docs, np.zeros(256))
    pure = sum(max(Counter(d % 8 for d in np.flatnonzero(leaf == x).tolist()).values()) for x in range(8))
    assert pure > 200


def test_clusters_let_a_search_leave_documents_out(spark, monkeypatch):
    """Bounds are above every score, and clusters below the k-th best are not read."""
    rng = random.Random(6)
    docs = [(d, d, Counter(rng.choice([f"t{d % 8}w{i}" for i in range(30)] + ["common"] * 5) for _ in range(40))) for d in range(512)]
    made = [(d, sum(c.values()), [t.encode() for t in c], np.fromiter(c.values(), np.uint32).tobytes()) for d, _, c in docs]
    import pyarrow as pa

    table = pa.Table.from_batches([*lexical._block(7, made, 512, 512 * 40)])
    text = [(f"t3w{i}".encode(), 1000) for i in range(12)] + [(b"common", 500)]
    read, plain = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda x, *a, **b: (read.append(len(x)), plain(x, *a, **b))[1])
    best = [*lexical._visit(table, [(0, 1)], [text], 5)]
    monkeypatch.undo()
    m = 25 + 75 * 40 * 512 // (512 * 40)
    want = sorted((-sum(w * (10**9 * c[t.decode()] // (1000 * c[t.decode()] + 8 * m)) for t, w in text if t.decode() in c), d) for d, _, c in docs)[:5]
    assert [(d, s) for _, d, s in best] == [(d, -s) for s, d in want]
    assert sum(read) < sum(len([t for t, _ in text if t.decode() in c]) for _, _, c in docs) * 0.8
