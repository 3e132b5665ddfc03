import os
import time

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gallerylens import models
from gallerylens.operators import align, classify, fragments, graph, index, merge, quantised, retrieval, sampling, textmetrics


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(120)] + [(200, [0.0] * 16), (201, [1.0] * 16), (202, [1.0] * 16)]
    return spark.createDataFrame(rows, "id long, v array<double>").repartition(3)


def hits(df):
    return sorted((r.qid, r["rank"], r.id, round(r.score, 9)) for r in df.collect())


def test_both_kernels_agree(vectors, monkeypatch):
    queries = vectors.where("id < 7 or id > 199").select(F.col("id").alias("qid"), F.col("v").alias("q"))
    assert hits(retrieval.knn(queries, vectors, 5)) == hits(retrieval.knn_expr(queries, vectors, 5))
    monkeypatch.setattr(retrieval, "BLOCK_VALUES", 40)  # several blocks of queries
    assert hits(retrieval.knn(queries, vectors, 5)) == hits(retrieval.knn_expr(queries, vectors, 5))
    assert retrieval.knn(queries.limit(0), vectors, 5).count() == 0


def test_maxsim_kernels_and_stages_agree(vectors, monkeypatch):
    tokens = vectors.where("id < 120").select((F.col("id") % 30).alias("id"), "v", (F.col("id") / 30).cast("int").alias("tok"))
    queries = tokens.where("id < 4").select(F.col("id").alias("qid"), F.col("tok").alias("qtok"), F.col("v").alias("q"))
    a = retrieval.rank(retrieval.maxsim(queries, tokens.drop("tok")), "qid", "score", "id", 5)
    documents = retrieval.by_document(tokens)
    assert hits(a) == hits(retrieval.maxsim_topk(queries, documents, 5))
    monkeypatch.setattr(retrieval, "BLOCK_VALUES", 40)  # several blocks of queries
    assert hits(a) == hits(retrieval.maxsim_topk(queries, documents, 5))
    assert retrieval.maxsim_topk(queries.limit(0), documents, 5).count() == 0
    assert hits(a) == hits(retrieval.two_stage(queries, documents, retrieval.pooled(documents, 1, 1, 2), 30, 5))  # all documents as candidates
    assert all(r[0] == r[2] for r in hits(a) if r[1] == 1)  # a document is nearest to itself


def test_ward():
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(size=(5, 3)) * 0.01 + c for c in ([0, 0, 0], [9, 9, 9], [-9, 5, 0])])
    assert retrieval.ward(v, 3).tolist() == [0] * 5 + [1] * 5 + [2] * 5
    assert retrieval.ward(v[:2], 8).tolist() == [0, 1]


def test_pooled(spark):
    rng = np.random.default_rng(3)
    docs = {1: rng.normal(size=(30, 4)), 2: rng.normal(size=(13, 4)), 3: rng.normal(size=(5, 4))}
    df = spark.createDataFrame([(i, m.tolist()) for i, m in docs.items()], "id long, vs array<array<double>>")
    got = {r.id: np.array(r.vs) for r in retrieval.pooled(df).collect()}
    for i, m in docs.items():
        content, special = m[4:-7] if len(m) > 11 else m[:0], np.concatenate([m[:4], m[-7:]]) if len(m) > 11 else m
        want = [special.mean(axis=0)]
        if len(content):
            own = brute_ward(content, 8)
            want += [content[c].mean(axis=0) for c in own]
        assert np.allclose(got[i], want)
    assert got[1].shape == (9, 4) and got[2].shape == (3, 4) and got[3].shape == (1, 4)


def brute_ward(v, k):
    """Clusters as lists of rows: the union that adds least to the squared distances from the means, again and again."""
    spread = lambda c: ((v[c] - v[c].mean(axis=0)) ** 2).sum()
    own = [[i] for i in range(len(v))]
    while len(own) > min(k, len(v)):
        i, j = min(((i, j) for i in range(len(own)) for j in range(i + 1, len(own))), key=lambda p: spread(own[p[0]] + own[p[1]]) - spread(own[p[0]]) - spread(own[p[1]]))
        own[i] += own.pop(j)
    return sorted(own, key=min)


def test_ward_by_chain():
    """The same clusters as merging over all pairs, also with copies, and a page's thousand vectors at once."""
    rng = np.random.default_rng(8)
    for n, k in ((1, 1), (2, 1), (5, 9), (40, 8), (60, 3), (90, 20)):
        v = rng.normal(size=(n, 6)) + 4 * rng.integers(0, 3, (n, 1))
        v[n // 2] = v[0]
        own = retrieval.ward(v, k)
        assert [np.flatnonzero(own == c).tolist() for c in range(own.max() + 1)] == [sorted(c) for c in brute_ward(v, k)]
    assert retrieval.ward(np.zeros((50, 4)), 3).max() == 2
    began = time.perf_counter()
    assert retrieval.ward(rng.normal(size=(1000, 128)), 8).max() == 7
    assert time.perf_counter() - began < 5  # well under a second on a quiet machine


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_recall_of_two_stages(spark):
    """Against the exact search over the same table, with the settings of the registered queries."""
    from gallerylens.plans import vectors as plans
    from gallerylens.plans.views import Tables

    for sf in ("sf0.01", "sf0.1"):
        t = Tables(spark, f"/root/testdata/{sf}")
        assert retrieval.recall(plans.two_stage_retrieval(t), plans.maxsim_full(t)) >= 0.9
        exact = plans.knn_cosine_topk(t)
        assert retrieval.recall(plans.binary_quant_topk(t), exact) >= 0.9
        assert retrieval.recall(plans.knn_index(t), exact) >= 0.9
        corpus = t.vec().select(F.col("vec_id").alias("id"), "v")
        oversample = index.sign_share(corpus, 0.95, 5) * corpus.count() / 5
        asked = corpus.where("id % 20 = 0").select(F.col("id").alias("qid"), F.col("v").alias("q"))
        assert retrieval.recall(quantised.binary_topk(asked, corpus, 5, oversample), exact) >= 0.9


def test_index_holds_every_row(vectors, tmp_path):
    made = index.build(vectors, f"{tmp_path}/index", lists=7)
    rows = made.rows(vectors.sparkSession)
    assert sorted(r.id for r in rows.collect()) == sorted(r.id for r in vectors.collect()) and 1 <= made.probes <= 7
    queries = vectors.where("id < 9").select(F.col("id").alias("qid"), F.col("v").alias("q"))
    made.probes = 7  # all lists: the exact search
    assert hits(index.search(made, queries, 5)) == hits(retrieval.knn(queries, vectors, 5))
    many = index.build(vectors, f"{tmp_path}/many", lists=2_600)  # more lists than are fitted at once: by cells
    many.probes = len(many.found)
    assert hits(index.search(many, queries, 5)) == hits(retrieval.knn(queries, vectors, 5))
    made.probes = 1
    plan = index.search(made, queries.limit(1), 5)._jdf.queryExecution().toString()
    assert "PartitionFilters: [list" in plan or "PartitionFilters: [isnotnull(list" in plan
    assert index.search(index.build(vectors.limit(0), f"{tmp_path}/none"), queries.limit(0), 5).count() == 0


def test_retrieve_context(spark):
    class Letters:
        def tokens(self, texts):
            return [[[float(w == x) for x in "abc"] for w in t.split()] or [[0.0] * 3] for t in texts]

    docs = spark.createDataFrame([(1, "A", "a a", ["one"]), (2, "B", "b", []), (3, "C", "c c", [])], "id long, title string, text string, captions array<string>")
    vectors = spark.createDataFrame([(i, v) for i, v in zip((1, 2, 3), Letters().tokens(["a a", "b", "c c"]), strict=True)], "id long, vs array<array<double>>")
    asked = spark.createDataFrame([(9, "c b"), (8, None)], "qid int, text string")
    got = {r.qid: r for r in retrieval.retrieve_context(asked, Letters(), docs, vectors, vectors, k=2).collect()}
    assert got[9].ids == [2, 3] and got[9].context.startswith("# Context\n\n## Document 1: B\nScore: 1.00.\n\n### Document Text\nb\n\n## Document 2: C")
    assert "### Image 1\nCaption: one\n\n### Document Text\na a" in got[8].context


def test_query_times():
    total, each = retrieval.query_times([1, 2], lambda q: sum(range(1000 * q)))
    assert total > 0 and abs(each - total / 2) < 1e-12


def test_page_fragments(spark):
    long = lambda w: " ".join([w] * 40)
    pages = [
        (1, f'Title\n\n<a href="InfoboxHeader%3Abox%20a.png"> box </a>\n{long("intro")}\nshort\n<a href="File%3Aone.jpg">first</a>{long("after")}\nBULLET:::: {long("x")}\n<a href="File%3Atwo.jpg">second</a>tiny\n<a href="File%3Athree.jpg">third</a>\n{long("last")}  {long("line")}'),
        (2, f"Only heading\n{long('plain')}"), (3, f'Head\n<a href="File%3Aone.jpg">early</a>\n{long("text")}'), (4, ""), (5, None), (6, f'Box\n<a href="InfoboxHeader%3Abox%20a.png">b</a>'),
        (7, f'Gone\n<a href="File%3Amissing.jpg">no</a>\n{long("some")}'),
    ]
    df = spark.createDataFrame([(i, "t", f"u?curid={i}", x) for i, x in pages], "page_id int, title string, url string, text string")
    files = spark.createDataFrame([(f,) for f in ("box_a.png", "one.jpg", "two.jpg", "three.jpg")], "file string")
    got = fragments.page_fragments(df, files).orderBy("id").collect()
    assert [r.id for r in got] == list(range(6)) and all(r.wiki_id == r.page_id for r in got)
    assert [(r.page_id, r.paragraph_id, r.text.split()[0], [x.caption for x in r.images]) for r in got] == [
        (1, 0, "intro", ["box"]), (1, 1, "after", ["first"]), (1, 2, "last", ["second", "third"]), (2, 0, "plain", []), (3, 0, "text", ["early"]), (7, 0, "some", []),
    ]
    assert got[0].images[0].type == "infobox" and got[0].images[0].file == "box_a.png" and "  " not in got[2].text


def test_ranking_metrics(spark):
    found = spark.createDataFrame([(1, 1, 1), (2, 9, 1), (2, 2, 3), (3, 8, 1)], "qid int, id int, rank int")
    gold = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (4, 4)], "qid int, gold int")
    r = retrieval.ranking_metrics(found, gold).first()
    assert (r.n, r.ndcg, r.recall1) == (4, round((1 + 0.5) / 4, 6), 0.25)


def test_closure_handles_cycles_and_depth(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("a", "c")], "parent string, child string")
    roots = spark.createDataFrame([("a",)], "node string")
    depth = lambda n: {r.node: r.depth for r in graph.closure(edges, roots, n).collect()}
    assert depth(0) == {"a": 0, "b": 1, "c": 1} and depth(1) == {"a": 0, "b": 1, "c": 1, "d": 2} and depth(9)["e"] == 3


def test_properties(spark):
    cells = spark.createDataFrame([(1, "x", None), (2, None, None), (3, "y", 5)], "id int, name string, size int")
    changes = graph.upsert_props(cells, "id", ["name", "size"])
    assert sorted(map(tuple, changes.collect())) == [(1, "name", "x"), (3, "name", "y"), (3, "size", "5")]
    nodes = spark.createDataFrame([(1, {"name": "old", "k": "v"}), (2, None)], "id int, props map<string,string>")
    assert {r.id: r.props for r in graph.apply_props(nodes, changes).collect()} == {1: {"name": "x", "k": "v"}, 2: {}}


def test_best_candidate_needs_a_positive_score(spark):
    q = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, [0.0, -1.0])], "id int, k int, v array<double>")
    c = spark.createDataFrame([(7, 0, [1.0, 0.0]), (6, 0, [2.0, 0.0]), (8, 0, [0.0, 1.0])], "cid int, k int, c array<double>")
    assert [(r.id, r.best) for r in align.best_candidate(q, c, "k").collect()] == [(1, 6)]


def test_split_partitions_each_stratum(spark):
    df = spark.range(1000).withColumn("s", (F.col("id") % 3).cast("string"))
    split = sampling.stratified_split(df, "s", "id", [("train", 0.7), ("val", 0.15), ("test", 0.15)])
    counts = {(r.s, r.split): r["count"] for r in split.groupBy("s", "split").count().collect()}
    assert split.count() == 1000 and all(abs(counts[s, "train"] - 0.7 * n) <= 1 and abs(counts[s, "test"] - 0.15 * n) <= 1 for s, n in (("0", 334), ("1", 333), ("2", 333)))
    assert sampling.stratified_sample(df, "s", "id", 101).count() == 101


def test_zip_checks_rows(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, image string")
    b = spark.createDataFrame([(1, "x", "r"), (2, "z", "s")], "k int, image string, ref string")
    with pytest.raises(PySparkException):
        merge.zip_rows(a, b, "k", "image").collect()


def test_merge_and_resume(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(merge.merge(old, new, ["k"], False)) == [(1, "a"), (2, "b"), (3, "C")]
    assert rows(merge.merge(old, new, ["k"], True)) == [(1, "a"), (2, "B"), (3, "C")]
    assert rows(merge.resume(new, old, "k")) == [(3, "C")] and merge.watermark(old.limit(0), "k").first().high == 0


def test_paragraphs_are_numbered_when_kept(spark):
    lines = [(1, 0, "x" * 120), (1, 1, "short"), (1, 2, "BULLET::::" + "y" * 120), (1, 3, "z " * 80), (2, 0, " ")]
    got = [(r.doc_id, r.paragraph_id) for r in fragments.paragraphs(spark.createDataFrame(lines, "doc_id int, pos int, line string")).orderBy("doc_id", "paragraph_id").collect()]
    assert got == [(1, 0), (1, 1)]


def test_packing_stops_at_the_first_overflow(spark):
    items = spark.createDataFrame([(1, i, h) for i, h in enumerate([5.0, 3.0, 9.0, 1.0, 1.0, 1.0])], "g int, n int, h double")
    packed = fragments.grid(items, "g", ["n"], "h")
    assert sorted((r.row, r.height, r.y) for r in packed.collect()) == [(0, 5.0, 0.0), (1, 9.0, 5.0), (2, 1.0, 14.0)]
    assert [r.row for r in fragments.within_budget(packed, 13).collect()] == [0]


def test_shards_cover_all_rows(spark):
    for n, total in ((4, 10), (4, 3), (1, 5)):
        got = fragments.shards(spark.range(total), "id", n).orderBy("shard").collect()
        assert sum(r.size for r in got) == total and [r.start for r in got] == [sum(x.size for x in got[:i]) for i in range(len(got))]


def test_wrapping_loses_no_word(spark):
    text = "a bb ccc " * 30 + "d" * 100
    lines = spark.createDataFrame([(text,), (None,)], "t string").select(fragments.wrap(F.col("t"), 20).alias("x")).collect()
    assert " ".join(lines[0].x).split() == text.split() and all(len(x) <= 20 or " " not in x for x in lines[0].x) and lines[1].x == []


def test_wrapping_by_glyphs(spark):
    """No line is wider than the page but those of one word, none could take the next word, and nothing is lost."""
    glyphs, other = {"i": 2.0, "w": 9.0, " ": 3.0}, 5.0
    wide = lambda s: sum(glyphs.get(x, other) for x in s)
    texts = ["will ww iii wiw  wi i " * 9, "wwwwwwwwwwwwww i", "", None, "éé éé ii"]
    got = [r.x for r in spark.createDataFrame([(t,) for t in texts], "t string").select(fragments.wrap_pixels(F.col("t"), 40.0, glyphs, other).alias("x")).collect()]
    for t, lines in zip(texts, got, strict=True):
        assert " ".join(lines).split(" ") == (t or "").split(" ") or lines[0] == ""
        for a, b in zip(lines, [*lines[1:], None], strict=True):
            assert wide(a + " ") <= 40 or " " not in a
            assert b is None or wide(a + " " + b.split(" ")[0] + " ") > 40 or a == ""
    assert got[1] == ["", "wwwwwwwwwwwwww", "i"] and got[2] == [""] and got[3] == [""]


def test_classification(spark):
    pred = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (3, 1), (None, 1)], "truth int, pred int")
    m, w = classify.macro(classify.per_class(pred)).first(), classify.weighted(classify.per_class(pred)).first()
    assert (m.accuracy, m.precision, m.recall) == (0.5, round((0.5 + 0.5 + 0) / 3, 6), 0.5) and w.recall == 0.5


def test_text_metrics_of_equal_texts(spark):
    h = spark.createDataFrame([(1, "the cat sat on the mat"), (2, "blue sky over green hills")], "id int, hyp string")
    r = h.select("id", F.lit(0).alias("ref_no"), F.col("hyp").alias("ref"))
    assert textmetrics.bleu(h, r).first()[:] == (1.0,) * 4
    assert {x.rouge for x in textmetrics.rouge_n(h, r, [2]).collect()} == {1.0} == {x.rouge_l for x in textmetrics.rouge_l(h, r).collect()}
    assert all(x.cider == 10.0 for x in textmetrics.cider(h, r).collect()) and all(x.meteor > 0.99 for x in textmetrics.meteor_exact(h, r).collect())
    assert textmetrics.robust_accuracy(spark.createDataFrame([(1, "Two", ["2", "two", "TWO.", "x"])], "id int, pred string, refs array<string>")).first().score == 1.0


def test_models(spark):
    df = spark.createDataFrame([(1, "red stone red"), (2, None)], "id long, text string")
    got = {r.id: r.v for r in models.embed(df, models.HashEmbedder(8), "id", "text").collect()}
    assert abs(np.linalg.norm(got[1]) - 1) < 1e-9 and got[2] == [0.0] * 8
    assert [r.id for r in models.judge(df, models.LengthJudge(2), "text").collect()] == [1]

    class Echo:
        def generate(self, prompts):
            return ["call"] if "seen" not in prompts[0] else ["done"]

    assert models.answer(Echo(), "q", {"f": lambda x: f"seen {x}"}, lambda t: [("f", {"x": 1})] if t == "call" else []) == ["q", "call", "seen 1", "done"]


def test_first_containing(spark):
    docs = spark.createDataFrame([(5, "abcab"), (3, "xbcx"), (9, ""), (None, "abc"), (7, None)], "doc_id long, text string").repartition(3)
    needles = spark.createDataFrame([(1, "bc"), (2, "abc"), (3, "zz"), (4, ""), (5, None), (6, "bc"), (7, "ab")], "item_id long, q string")
    want = {1: 3, 2: 5, 3: None, 4: 3, 5: None, 6: 3, 7: 5}
    for most in (2, 1000):
        assert {r.item_id: r.doc_id for r in fragments.first_containing(docs, needles, most).collect()} == want
    assert fragments.first_containing(docs, needles.limit(0)).count() == 0
    assert {r.doc_id for r in fragments.first_containing(docs.limit(0), needles).collect()} == {None}


def test_train_links(spark):
    """After training, a work's style is the nearest of all styles for most works; pinned entities stay."""
    triples = [(f"w{i}", "style", f"s{i % 3}") for i in range(30)] + [(f"w{i}", "by", f"a{i % 3}") for i in range(30)]
    df = spark.createDataFrame([*triples, triples[0]], "head string, rel string, tail string")
    pinned = spark.createDataFrame([("a0", [2.0] * 8)], "id string, p array<double>")

    def right(rounds):
        entities, relations = graph.train_links(df, dim=8, rounds=rounds, pinned=pinned)
        v = {r.id: np.array(r.v) for r in entities.collect()}
        style = {r.rel: np.array(r.v) for r in relations.collect()}["style"]
        assert len(v) == 36 and v["a0"].tolist() == [2.0] * 8 and all(abs(np.linalg.norm(x) - 1) < 1e-9 for i, x in v.items() if i != "a0")
        best = [min(range(3), key=lambda s: np.linalg.norm(v[f"w{i}"] + style - v[f"s{s}"])) for i in range(30)]
        return sum(b == i % 3 for i, b in enumerate(best))

    assert right(12) >= 27 > right(0)
    assert graph.train_links(df.limit(0))[0].count() == 0


def test_documents_shorter_than_their_mask(spark):
    """A document of fewer vectors than asked for has all of them, and each counts once in a mean."""
    df = spark.createDataFrame([([[1.0], [3.0], [8.0]],)], "vs array<array<double>>")
    got = df.select(retrieval.unpad(F.col("vs"), F.lit(5)).alias("a"), retrieval.unpad(F.col("vs"), F.lit(2)).alias("b"), retrieval.special_pool(F.col("vs")).alias("c")).first()
    assert (got.a, got.b, got.c) == ([[1.0], [3.0], [8.0]], [[3.0], [8.0]], [4.0])


def test_matches_need_no_pairs(spark):
    """Keys of many rows on both sides: a row a pair would be 40 thousand millions."""
    rows = spark.range(200_000).select(F.col("id").alias("lid"), F.lit("a").alias("title_key"), (F.col("id") % 2).alias("artist_key"))
    got = align.matches(rows, rows.where("artist_key = 1").withColumnRenamed("lid", "rid"), ["title_key", "artist_key"]).collect()
    assert [tuple(r) for r in got] == [("a", 1, 10_000_000_000)]


def test_shared_order_gives_the_hits_of_scores(spark):
    rng = np.random.default_rng(3)
    true = sorted({(int(i), int(i) % 4, f"l{rng.integers(6)}") for i in rng.integers(0, 40, 120)})
    made = spark.createDataFrame(true, "id long, by long, label string")
    ids = made.select("id", "by").distinct()
    share = made.groupBy("by", "label").agg(F.count("*").alias("n")).join(ids.groupBy("by").agg(F.count("*").alias("k")), "by").select("by", "label", (F.col("n") / F.col("k")).alias("score"))
    scores = ids.join(share, "by").join(made.withColumn("truth", F.lit(1)).drop("by"), ["id", "label"], "left").fillna(0, ["truth"])
    of = lambda df: sorted(tuple(r) for r in df.select("id", "n_true", "hits").collect())
    assert of(classify.shared_topn_hits(made)) == of(classify.topn_hits(scores))
