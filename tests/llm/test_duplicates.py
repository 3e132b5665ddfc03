import hashlib
import itertools
import random
import re

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from gallerylens.llm import components, exact, shingles, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def with_ids(found, n=1):
    """The rows that have a doc_id, after a look at how many have none: all operators keep them."""
    assert sum(r.doc_id is None for r in found) == n
    return [r for r in found if r.doc_id is not None]


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute_print(text):
    w = WORD.findall(lower(text))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(links, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_near_duplicates_brute_force(docs, rows):
    prints = {i: brute_print(t) for i, t in rows}
    ids = sorted(prints)
    links = [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
    want = roots(links, ids)
    found = simhash.near_duplicates(docs).collect()
    lone = next(r for r in found if r.doc_id is None)
    assert int(lone.fingerprint, 16) == brute_print("no id") and lone.component_id is None
    got = with_ids(found)
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in rows)
    assert all(int(r.fingerprint, 16) == prints[r.doc_id] and len(r.fingerprint) == 16 and r.component_id == want[r.doc_id] for r in got)


@pytest.mark.parametrize("split_at", [3, 10_000])
def test_fingerprint_links(spark, split_at):
    """Dense groups, with and without splitting of their nodes."""
    rng = random.Random(split_at)
    centres = [rng.getrandbits(64) for _ in range(20)]
    prints = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in centres for _ in range(25)} | {0, (1 << 64) - 1, 1 << 63}
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    df = spark.createDataFrame(list(zip(signed, range(len(signed)), strict=True)), "fp long, rep long")
    got = [(r.a, r.b) for r in simhash.fingerprint_links(df, split_at).collect()]
    n = len(signed)
    want = roots([(i, j) for i in range(n) for j in range(i) if ((signed[i] ^ signed[j]) & (1 << 64) - 1).bit_count() <= 2], range(n))
    assert roots(got, range(n)) == want
    assert len(got) < 6 * n


def test_trie_pairs_finds_every_pair():
    rng = np.random.default_rng(1)
    bits = np.unique(rng.integers(0, 1 << 32, 40, dtype=np.uint64) & np.uint64(0xF000_00FF)).astype(np.uint32)
    i, j = simhash.trie_pairs(bits, np.array([0, len(bits)]))
    want = {(a, b) for a in range(len(bits)) for b in range(a + 1, len(bits)) if int(bits[a] ^ bits[b]).bit_count() <= 2}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want and len(i) == len(want)


def brute_shingles(text):
    w = WORD.findall(lower(text))
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or {" ".join(w)}


@pytest.fixture(scope="session")
def edited():
    """Texts with a few words replaced, some pairs above and some below 0.8, and a passage that many texts share."""
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(3000)]
    shared, rows = [rng.choice(vocabulary) for _ in range(25)], []
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(20, 200))] + shared
        rows.append(base)
        for _ in range(4):
            other = list(rows[-1])
            for _ in range(rng.randint(0, len(base) // 25)):
                other[rng.randrange(len(other))] = rng.choice(vocabulary)
            rows.append(other[rng.randint(0, 4) :])
    return list(enumerate([" ".join(r) for r in rows] + ["a b", "A  b", "a c", "", None]))


def similar_roots(rows):
    ids, sets = sorted({i for i, _ in rows}), {i: brute_shingles(t) for i, t in rows}
    links = [(a, b) for a, b in itertools.combinations(ids, 2) if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    return roots(links, ids)


@pytest.mark.parametrize("common", [2, 10**9])
def test_similar_documents_brute_force(spark, docs, rows, edited, monkeypatch, common):
    """Every pair of a Jaccard similarity of 0.8 or more is linked and no other, in whichever order shingles are."""
    monkeypatch.setattr(shingles, "COMMON", common)
    for df, of, n in ((docs, rows, 1), (spark.createDataFrame(edited, "doc_id long, text string"), edited, 0)):
        found = with_ids(shingles.similar_documents(df).collect(), n)
        got = [(r.doc_id, r.component_id) for r in found]
        assert all(r.kept == (r.doc_id == r.component_id) for r in found)
        want = similar_roots(of)
        assert sorted(got) == sorted((i, want[i]) for i, _ in of)


def test_near_stage_keeps_one_of_each_group(spark, edited):
    df = spark.createDataFrame(edited, "doc_id long, text string")
    want = similar_roots(edited)
    assert len(set(want.values())) < len(want) - 10
    assert sorted(r.doc_id for r in corpus_pipeline.near_stage(spark, df, "").collect()) == sorted(set(want.values()))


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (500, 500), (200, 201), (201, 200)] + [(300, rng.randint(301, 330)) for _ in range(40)]
    df = spark.createDataFrame([*links, (None, 5)], "a long, b long")
    got = {r.node: r.component for r in components.connected_components(df).collect()}
    want = roots(links, {x for p in links for x in p})
    assert got == {n: c for n, c in want.items() if n != 500}
    assert components.connected_components(df.limit(0)).count() == 0


@pytest.mark.parametrize("budget", [64 << 20, 2_000])
def test_exact_dedup_brute_force(docs, rows, budget):
    """With a small budget the buckets go to spill files again and again."""
    groups: dict[str, list] = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    want = sorted((i, min(g)[1], len(g), hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for _, i in g)
    found = exact.exact_dedup(docs, budget=budget).collect()
    lone = next(r for r in found if r.doc_id is None)
    assert (lone.keep_id, lone.group_size, lone.kept) == (None, 1, True)
    got = with_ids(found)
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = [r.doc_id for r in got if r.kept]
    assert len(kept) == len(groups) and all(r.keep_id == r.doc_id for r in got if r.kept)


def test_exact_dedup_of_rows_without_ids(spark):
    rows = [(None, "a b"), (None, "ab"), (7, "a b"), (None, "x  "), (3, "x")]
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(None, 7, 3, False), (None, 7, 3, False), (7, 7, 3, True), (None, None, 2, True), (3, None, 2, False)], key=str)


def test_near_duplicates_of_rows_without_ids(spark):
    rows = [(None, "a b c d"), (None, "a b c d"), (9, "A B c d"), (None, None), (4, "  "), (None, "other words that are on their own")]
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(None, 9), (None, 9), (9, 9), (None, 4), (4, 4), (None, None)], key=str)


def test_sketches_never_part_similar_sets():
    rng = np.random.default_rng(8)
    for n in (1, 20, 400, 3000):
        a = np.unique(rng.integers(0, 1 << 64, n, np.uint64))
        for k in (0, 1, n // 10, n // 5):
            b = np.unique(np.concatenate([a[k:], rng.integers(0, 1 << 64, k, np.uint64)]))
            bits = (int.from_bytes(shingles.sketch(a)) ^ int.from_bytes(shingles.sketch(b))).bit_count()
            assert bits <= len(np.setxor1d(a, b))
    assert len(shingles.sketch(a)) * 8 == shingles.SKETCH


def test_grace_recursion_of_one_content():
    rows = [(b"x" * 1000, (i,)) for i in range(50)] + [(bytes([i]) * 900, (100 + i,)) for i in range(40)]
    got = dict(exact.grace_classes(rows, 1500))
    assert len(got) == 41 and len(got[b"x" * 1000]) == 50


def test_open_table_tells_equal_hashes_apart():
    table = exact.OpenTable()
    assert [table.place(5, c)[0] for c in (b"a", b"b", b"a", b"c")] == [0, 1, 0, 2]
    for i in range(5000):
        table.place(i * 1024, str(i).encode())
    assert table.place(0, b"0") == (3, False)


def test_empty(empty):
    assert simhash.near_duplicates(empty).count() == 0
    assert shingles.similar_documents(empty).count() == 0
    assert exact.exact_dedup(empty).count() == 0


def test_near_documents_meet_by_fingerprints_first(spark, monkeypatch):
    """Near documents were found by shingles alone."""
    from gallerylens.llm import shingles, simhash

    text = " ".join(f"w{i}" for i in range(400))
    docs = spark.createDataFrame([(0, text), (1, text + " more"), (2, " ".join(f"x{i}" for i in range(90)))], "doc_id long, text string")
    asked = []
    monkeypatch.setattr(shingles, "candidate_pairs", lambda nodes: asked.append(simhash.candidate_pairs(nodes)) or asked[0])
    got = sorted(tuple(r) for r in shingles.similar_documents(docs).select("doc_id", "component_id", "kept").collect())
    assert got == [(0, 0, True), (1, 0, False), (2, 2, True)]
    assert asked[0].count() == 1
