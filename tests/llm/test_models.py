import math
import random
import time
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from gallerylens.llm import toxicity, urls

PLAIN = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "nu") for b in ("ra", "se", "ti", "vo") for c in ("n", "s", "th", "x")]
RUDE = ["idiot", "scum", "loser"]


def texts(n, seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        toxic = int(rng.random() < 0.3)
        words = [rng.choice(PLAIN) for _ in range(rng.randint(30, 120))]
        for _ in range(4 * toxic):
            words[rng.randrange(len(words))] = rng.choice(RUDE)
        rows.append((i, " ".join(words), toxic))
    return rows


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder of tables: documents with copies, near copies, secrets, nulls and toxic texts, and labels of most."""
    rows = texts(400)
    rng = random.Random(5)
    full = [(i, t, None if i % 9 == 0 else "en", "src", len(t)) for i, t, _ in rows]
    full += [(1000 + i, full[i][1] + " ", "en", "src", 0) for i in range(30)]
    long = " ".join(rng.choice(PLAIN) for _ in range(3000))
    full += [(2000, long, "en", "src", 0), (2001, long + " " + PLAIN[0], "en", "src", 0)]
    full += [(3000, f"{long[:900]} token = {'ab12' * 10} end", "en", "src", None), (3001, None, None, None, None), (3002, "", "en", "", 0), (None, "no id", "en", "src", 5)]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, x) for i, _, x in rows] + [(5000, 1, 1), (None, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_held_out_accuracy(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{corpus}/labels.parquet"))
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    truth = {i: x for i, _, x in texts(400)}
    held = [r for i, r in got.items() if r.held_out and i in truth]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items() if i is not None) and not got[None].held_out
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) >= 0.95
    assert got[3001].score == got[3002].score  # null as empty
    # the text alone decides
    moved = docs.where('doc_id is not null').selectExpr("doc_id + 1000000 as doc_id", "text", "'xx' as lang", "'z' as source")
    assert {r.doc_id - 1000000: r.score for r in toxicity.score_toxicity(moved, model).collect()} == {i: r.score for i, r in got.items() if i is not None}


def test_held_out_labels_are_not_read(spark, corpus):
    docs, labels = spark.read.parquet(f"{corpus}/documents.parquet"), spark.read.parquet(f"{corpus}/labels.parquet")
    other = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - toxic else toxic end as toxic")
    a, b = toxicity.train(docs, labels), toxicity.train(docs, other)
    assert np.array_equal(a.table.keys, b.table.keys) and np.allclose(a.table.ratio, b.table.ratio) and np.allclose([a.intercept, a.slope], [b.intercept, b.slope])


def test_few_labels(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    for some in ("false", "toxic = 0", "doc_id < 3"):
        model = toxicity.train(docs, spark.read.parquet(f"{corpus}/labels.parquet").where(some))
        assert all(0 <= r.score <= 1 for r in toxicity.score_toxicity(docs.limit(20), model).collect())
    model = toxicity.train(docs.limit(0), spark.read.parquet(f"{corpus}/labels.parquet"))
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0


def brute_expressions(rows):
    """The log-likelihood ratios of words, and of pairs that toxic texts hold, by sets of contexts."""
    contexts: dict[tuple, list[set]] = {}
    for text, toxic in rows:
        w = [None, *re.sub("[A-Z]", lambda m: m[0].lower(), re.sub(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", " ", text)).split()]
        for k in range(1, len(w)):
            contexts.setdefault((w[k],), [set(), set()])[toxic].add(w[k - 1])
            if k > 1:
                contexts.setdefault((w[k - 1], w[k]), [set(), set()])[toxic].add(w[k - 2])
    counts = {x: (len(c[0]), len(c[1]), len(c[0] | c[1])) for x, c in contexts.items() if len(x) == 1 or c[1]}

    def level(size, discount):
        own = [n for x, n in counts.items() if len(x) == size]
        total = [max(sum(n[c] for n in own), 1) for c in range(3)]
        freed = [sum(min(n[c], discount) for n in own) / total[c] for c in range(3)]
        shared = min(max(freed[:2]), 1)
        scale = [(1 - shared) / (1 - f) if f < 1 else 0 for f in freed[:2]] + [1]
        return lambda n, c: max(n[c] - discount, 0) / total[c] * scale[c], shared, freed[2]

    seen, shared, free = level(1, 0.75)
    types = sum(len(x) == 1 for x in counts)
    p = {x: seen(n, 2) + free / (types + 1) for x, n in counts.items() if len(x) == 1}
    own = {x: [seen(counts[x], c) + shared * p[x] for c in (0, 1)] for x in p}
    out = {x: math.log(q[1] / q[0]) for x, q in own.items()}
    assert all(math.isclose(sum(q[c] for q in own.values()) + shared * free / (types + 1), 1) for c in (0, 1))
    seen, shared, free = level(2, 1)
    for (v, w), n in [(x, n) for x, n in counts.items() if len(x) == 2]:
        q = [seen(n, c) + shared * (seen(n, 2) + free * p[v,] * own[w,][c]) for c in (0, 1)]
        out[v, w] = math.log(q[1] / q[0])
    return out


@pytest.mark.parametrize("seed", range(2))
def test_ratios_brute_force(spark, seed):
    """Every word's and pair's ratio, and each text's strongest expression."""
    rows = [(t, x) for _, t, x in texts(60, seed)] + [(f"{a} total waste of ka A1-b", 1) for a in PLAIN[:9]] + [(f"{a} total of {a} waste", 0) for a in PLAIN[:30]] + [("", 0), ("idiot", 1)]
    want = brute_expressions(rows)
    df = spark.createDataFrame(rows, "text string, toxic int").repartition(3)
    words, pairs = toxicity.expressions(df)
    hashes = lambda x: [toxicity.word_hash(w.encode()) for w in x]
    got = {(r.w,): r.ratio for r in words.collect()} | {(r.v, r.w): r.ratio for r in pairs.collect()}
    assert got.keys() == {tuple(hashes(x)) for x in want}
    assert all(abs(got[tuple(hashes(x))] - r) < 1e-9 for x, r in want.items())
    assert want["total", "waste"] > max(want["total",], want["waste",], 0)  # a pair that says more than its words
    model = toxicity.fit(df, df)
    scored = {r.text: r.x for r in model.measured(df.select("text"), "text", lambda b, x: pa.RecordBatch.from_arrays([b.column("text"), pa.array(x)], ["text", "x"]), "text string, x double").collect()}
    for text, _ in rows:
        w = text.replace("A1-b", "a1 b").split()
        assert abs(scored[text] - max([0, *(want[x,] for x in w), *(want.get(x, 0) for x in zip(w, w[1:], strict=False))])) < 1e-9


def test_words_do_not_share_counts(spark):
    """More types than any fixed number of bins of 2^18 keeps apart: each has its own counts."""
    rows = [(" ".join(f"w{k}" for k in range(a, a + 5000)), a // 5000 % 2) for a in range(0, 300_000, 5000)]
    words, _ = toxicity.expressions(spark.createDataFrame(rows, "text string, toxic int"))
    assert words.count() == 300_000


def test_copies_add_nothing(spark):
    rows = [(t, x) for _, t, x in texts(40)]
    once, often = (toxicity.expressions(spark.createDataFrame(r, "text string, toxic int"))[0].collect() for r in (rows, rows + 50 * rows[:5]))
    assert np.allclose(sorted(map(tuple, once)), sorted(map(tuple, often)), rtol=1e-12)


def test_logistic():
    x, y = np.array([0.0, 0.1, 2.0, 2.1]), np.array([0, 0, 1, 1])
    a, b = toxicity.logistic(x, y)
    assert b > 0 and a + b * 0.1 < 0 < a + b * 2
    assert toxicity.logistic(x, 1 - y)[1] == 0  # never the other way round
    assert toxicity.logistic(x[:0], y[:0])[0] < -6 and toxicity.logistic(np.zeros(4), y)[0] == 0


def test_expressions_that_are_not_broadcast(spark, corpus, monkeypatch):
    docs, labels = spark.read.parquet(f"{corpus}/documents.parquet"), spark.read.parquet(f"{corpus}/labels.parquet")
    whole = toxicity.train(docs, labels)
    want = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, whole).collect()}
    monkeypatch.setattr(toxicity, "BROADCAST_ROWS", 1)
    model = toxicity.train(docs, labels)
    assert len(model.table.keys) == 1 and model.rest.count() >= len(whole.table.keys) - 1 > 2
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, model).collect()}
    assert got.keys() == want.keys() and np.allclose([got[i] for i in want], list(want.values()))
    assert {r.doc_id for r in toxicity.keep_ordinary(docs, model).collect()} == {r.doc_id for r in toxicity.keep_ordinary(docs, whole).collect()}


def test_clashing_columns_and_repeated_rows(spark, corpus):
    """Columns named as the operator's own; rows that repeat an id, or have none, are scored each for itself."""
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{corpus}/labels.parquet"))
    odd = spark.createDataFrame([(1, "idiot scum", "a", 1.0, 2), (1, "ka ra", "b", None, None), (None, "idiot scum", None, None, None), (None, None, None, None, None)], "doc_id long, text string, score string, ratio double, toxic int")
    got = sorted((r.doc_id is None, r.held_out, r.predicted) for r in toxicity.score_toxicity(odd, model).collect())
    held = zlib.crc32(b"1") % 5 == 0
    assert got == sorted([(False, held, 1), (False, held, 0), (True, False, 1), (True, False, 0)])
    left = toxicity.keep_ordinary(odd, model)
    assert left.dtypes == odd.dtypes and sorted(map(str, left.collect())) == sorted(map(str, odd.where("text is null or text = 'ka ra'").collect()))


def test_cascade_is_exact():
    rng = random.Random(1)
    universe = sorted({f"h{rng.random()}" for _ in range(3000)})
    for n in (0, 1, 50, 1500, 3000):
        listed = set(rng.sample(universe, n)) | {"outside"}
        made = urls.Cascade.load(urls.Cascade.build(urls.hashed(sorted(listed)), urls.hashed([k for k in universe if k not in listed])).dump())
        every = [*universe, "outside"]
        assert made.holds(urls.hashed(every)).tolist() == [k in listed for k in every]


@pytest.mark.parametrize("shipped", [32 << 20, 0])
def test_many_listed_domains(spark, shipped):
    """A million listed domains in several shards; hosts are listed by themselves, by a parent, or not."""
    listed = spark.range(1_000_000).selectExpr("concat('d', id, '.example.com') AS key")
    hosts = spark.range(30_000).selectExpr("CASE id % 3 WHEN 0 THEN concat('d', id * 30, '.example.com') WHEN 1 THEN concat('a.b.d', id, '.example.com') ELSE concat('e', id, '.example.com') END AS host", "id % 3 < 2 AS want")
    got = urls.listed_hosts(hosts, listed, shipped)
    assert got.count() == 30_000 and got.where("listed != want").count() == 0


PAGES = [
    (1, "https://A.cheap-pills.example.com/x?q", "a.cheap-pills.example.com", "/x", None, "block"), (2, "http://cheap-pills.example.com/fr/1#t", "cheap-pills.example.com", "/fr/1", "com/fr/", "allow"),
    (3, "http://x.example.org/es/1", "x.example.org", "/es/1", "example.org/es/", "block"), (4, "http://x.example.org/en/12", "x.example.org", "/en/12", "example.org/en/1", "block"), (5, "http://notexample.org/es/1", "notexample.org", "/es/1", "org/", "allow"),
    (6, None, "", "", None, "allow"), (7, "no scheme/de/", "", "", None, "allow"), (8, "http://org", "org", "", None, "allow"), (9, "a://b://c.com/de/", "b:", "//c.com/de/", None, "allow"), (10, "http://spam-farm.example.org", "spam-farm.example.org", "", None, "block"), (11, "http://x.net\n/a", "x.net\n", "/a", None, "allow"),
]


@pytest.mark.parametrize("shipped", [32 << 20, 0])
def test_urls(spark, monkeypatch, shipped):
    """With cascades that may not be broadcast, keys are looked up shard by shard."""
    monkeypatch.setattr(urls.listed_hosts, "__defaults__", (shipped,))
    monkeypatch.setattr(urls, "SHARD_KEYS", 5)
    pages = spark.createDataFrame([(i, u, "h", "k") for i, u, *_ in PAGES] + [(1, PAGES[0][1], "h", "k")], "page_id long, url string, host string, listed string")
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(pages).collect())
    assert got == sorted((i, *rest) for i, _, *rest in [*PAGES, PAGES[0]])
    assert urls.judge_urls(pages.limit(0)).count() == 0


@pytest.mark.parametrize("shipped", [32 << 20, 0])
def test_hosts_of_very_many_labels(spark, monkeypatch, shipped):
    """100,000 labels cost their length, not its square; the end of a long host is judged like a short one."""
    monkeypatch.setattr(urls.listed_hosts, "__defaults__", (shipped,))
    long = "a." * 100_000
    pages = [(1, f"http://{long}spam-farm.example.org/x"), (2, f"http://{long}other.example.org/x"), (3, "http://" + "x" * 300_000 + "spam-farm.example.org"), (4, "http://" + "." * 50_000), (5, f"http://{'b' * 400}.free-prizes.example.net")]
    df = spark.createDataFrame(pages, "page_id long, url string")
    began = time.perf_counter()
    got = {r.page_id: r.verdict for r in urls.judge_urls(df, rules=[]).select("page_id", "verdict").collect()}
    assert got == {1: "block", 2: "allow", 3: "allow", 4: "allow", 5: "block"} and time.perf_counter() - began < 40
    longer = spark.createDataFrame([("c." * 300 + "d",), ("d",)], "key string")  # longer than any domain, and still exact
    hosts = spark.createDataFrame([("c." * 300 + "d", True), ("c." * 300 + "e", False), ("x." + "c." * 300 + "d", True), ("c.d", True), ("cd", False)], "host string, want boolean")
    assert urls.listed_hosts(hosts, longer, shipped).where("listed != want").count() == 0


def test_pipeline(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, corpus)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == docs.columns and after.dtypes == docs.dtypes
        after = spark.createDataFrame(after.collect(), after.schema)
        kept[name] = after
        docs = after
    ids = {n: [r.doc_id for r in d.collect()] for n, d in kept.items()}
    truth = {i: x for i, _, x in texts(400)}
    tox = set(ids["toxicity"])
    assert np.mean([(i in tox) == (not x) for i, x in truth.items()]) > 0.95 and {None, 3001} <= tox
    copies = {1000 + i for i in range(30)}
    assert not (set(ids["exact dedup"]) & {c - 1000 for c in copies if c in tox})  # the longer original stays
    near = set(ids["simhash near-dedup"])
    assert (2000 in near) and 2001 not in near and len(near) > 250
    red = {r.doc_id: r for r in kept["secret scans"].collect()}
    assert "[secret]" in red[3000].text and red[3000].n_chars == len(red[3000].text) and set(red) == near
    packed = kept["best-fit packing"].collect()
    assert {r.doc_id for r in packed} == near
    assert sorted(map(tuple, corpus_pipeline.run(spark, corpus).select("doc_id", "piece", "start", "length", "ids_crc32").collect()), key=str) == sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed), key=str)
