"""Alignment against a version that works on byte offsets and all link occurrences of all documents."""

import bisect
import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings, strategies as st

from gallerylens.llm import alignment

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = ["", " ", "  a  b \n\n c\t d ", "<|endoftext|> a<|endoftext|>b", "a▁b", "▁", "日本語 のテ 日本語", "😀😀 naïve \x00 x", "a" * 90, "don't we'll 12345 ==== ----", " lead", "trail ", "\n\n", "x  \x1c y", "ɐ\U0001f9ff﻿"]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def groups_of(text, libraries):
    """[(A ids, B ids)] of the whole text, by sets of byte offsets."""
    a, b = libraries
    if not text:
        return []
    alphabet = alignment.byte_alphabet()
    x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    xb = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in x]
    yb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
    if not b"".join(xb) == b"".join(yb) == (" " + text).encode():
        return []
    xe, ye = np.cumsum([*map(len, xb)]).tolist(), np.cumsum([*map(len, yb)]).tolist()
    ends = sorted(set(xe) & set(ye))
    out = [([], []) for _ in ends]
    for side, (ids, own) in enumerate(((x, xe), (y, ye))):
        for i, e in zip(ids, own, strict=True):
            out[bisect.bisect_left(ends, e)][side].append(i)
    return out


def brute(rows, libraries):
    made = [(i, groups_of(t, libraries)) for i, t in rows]
    links = [[(p, q) for left, right in g for p in left for q in right] for _, g in made]
    count = Counter(pair for own in links for pair in set(own))
    best = defaultdict(int)
    for (p, _), n in count.items():
        best[p] = max(best[p], n)
    out = Counter()
    for (i, g), own in zip(made, links, strict=True):
        said = ";".join(",".join(map(str, left)) + "|" + ",".join(map(str, right)) for left, right in g)
        out[i, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(own), sum(count[k] == best[k[0]] for k in own), sum(count[k] for k in own), hashlib.sha256(said.encode()).hexdigest() if g else "", said] += 1
    return out, count


def test_documents(spark, docs, rows, empty, libraries):
    extra = spark.createDataFrame([(1000 + k, t) for k, t in enumerate(ODD)], "doc_id long, text string")
    every = docs.select("doc_id", "text").unionAll(extra)
    want, count = brute([*rows, (None, "no id"), *((1000 + k, t) for k, t in enumerate(ODD))], libraries)
    got = alignment.align_documents(every, A, B)
    assert Counter(map(tuple, got.collect())) == want
    table = alignment.count_pairs(every, A, B).collect()
    assert {(r.key >> 32, r.key & 0xFFFFFFFF): r.n for r in table} == count and len(table) == len(count)
    assert alignment.align_documents(empty, A, B).collect() == [] and alignment.count_pairs(empty, A, B).collect() == []


def test_bounded_memory_gives_the_same(spark, docs, monkeypatch):
    """Tasks that pass pairs on early, and many shards."""
    want = Counter(map(tuple, alignment.align_documents(docs, A, B, with_groups=False).collect()))
    monkeypatch.setattr(alignment, "HELD", 40)
    monkeypatch.setattr(alignment, "SHARD_ROWS", 200)
    assert Counter(map(tuple, alignment.align_documents(docs, A, B, with_groups=False).collect())) == want


def test_documents_without_any_pair(spark):
    got = alignment.align_documents(spark.createDataFrame([(1, None), (2, "▁")], "doc_id long, text string"), A, B)
    assert {tuple(r) for r in got.collect()} == {(i, 0, 0, 0, 0, 0, 0, "", "") for i in (1, 2)}


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("  ▁\naeithrsé日")), max_size=60))
def test_any_text(libraries, text):
    aligner = alignment.Aligner.of(A, B)
    made = align(aligner, [text])
    assert made.texts(alignment.kept_names(aligner))[0] == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups_of(text, libraries))


def align(aligner, found):
    sizes = [np.array([len(x) for x in own]) for own in (aligner.a_bytes, aligner.b_bytes)]
    return alignment.Alignment(*([np.array(x, np.int64) for x in own] for own in aligner.encode(found)), *sizes)


def test_wide_groups_link_all_pairs(monkeypatch):
    aligner = alignment.Aligner.of(A, B)
    found = [*ODD, "日本語 " * 50, "abc" * 400, ""]
    want = align(aligner, found).pairs()
    monkeypatch.setattr(alignment, "WIDE", 1)
    assert all(np.array_equal(x, y) for x, y in zip(want, align(aligner, found).pairs(), strict=True))


def test_very_long_texts(libraries):
    aligner = alignment.Aligner.of(A, B)
    for text in ("a" * 300_000, "x" + " " * 200_000 + "y", "word " * 60_000):
        made = align(aligner, [text, "b"])
        left, right = libraries[0].encode(" " + text, add_special_tokens=False).ids, libraries[1].encode(text)
        assert (made.n_a[0], made.n_b[0]) == (len(left), len(right)) and made.per_document(made.p * made.q)[0] == made.pairs()[2][made.pairs()[0] == 0].sum()


def test_summed():
    keys, counts = alignment.summed(np.array([5, 1, 5, 1, 9]), np.array([1, 2, 3, 4, 5]))
    assert keys.tolist() == [1, 5, 9] and counts.tolist() == [6, 4, 5]
