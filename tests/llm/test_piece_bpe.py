"""The backtracking encoder against the library, and against merging as the definition has it."""

import hashlib
import random
from collections import Counter

import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st

from gallerylens.llm import piece_bpe

PATH = P.path("piece_bpe_32k.model")
ODD = ["", " ", "a", "  the", "▁a", "<s>", "</s> <unk>", "<0x41>", "\x00a", "a\x00", "日本語 のテ", "😀😀 x", "a" * 300, " " * 40 + "x", "x" + " " * 17, "▁", "a▁b", "\n\n", "\t a", "a  b   c    d", "…　﻿​", "ɐɐ\U0001f9ff", "x \n y", "\r\n"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def codec():
    return piece_bpe.Codec(PATH)


def same(codec, library, text):
    (ids,) = codec.encode([text])
    want = library.encode(text)
    assert ids.tolist() == want
    assert codec.decoder.text(ids) == library.decode(want)


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(codec, library, text):
    same(codec, library, text)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" ▁\naeithrsé日")), max_size=60))
def test_any_text(codec, library, text):
    same(codec, library, text)


def test_texts_of_pieces(codec, library):
    rng = random.Random(3)
    names = list(codec.encoder.scores)
    for _ in range(3000):
        same(codec, library, "".join(rng.choice(names) for _ in range(rng.randint(1, 12))).replace(piece_bpe.SPACE, rng.choice([" ", piece_bpe.SPACE])))


def test_the_whole_text_without_cuts(codec):
    rng = random.Random(4)
    text = " ".join("".join(rng.choice("etaoinshr  é") for _ in range(rng.randint(1, 9))) for _ in range(300))
    marked = piece_bpe.SPACE + text.replace(" ", piece_bpe.SPACE)
    assert codec.encoder.encode(marked) == codec.encode([text])[0]
    assert codec.encoder.tokens(marked[:200]) == codec.encoder.merged(marked[:200])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 31_999), st.integers(0, 270)), max_size=25))
def test_decoding_of_any_ids(codec, library, ids):
    assert codec.decoder.text(piece_bpe.array("I", ids)) == library.decode(ids)


def test_backtracking_is_needed_and_happens(codec):
    """Texts of which the longest piece first is not the encoding."""
    greedy = lambda t: (k := next(k for k in range(len(t), 0, -1) if t[:k] in codec.encoder.scores), [t[:k]] + (greedy(t[k:]) if t[k:] else []))[1]
    rng, other = random.Random(5), 0
    for _ in range(500):
        t = "".join(rng.choice("aeinrst") for _ in range(14))
        other += greedy(t) != codec.encoder.tokens(t)
    assert other > 50


def test_a_very_long_run(codec, library):
    for t in ("a" * 300_000, " " * 100_000 + "b", "abcdefghij" * 20_000):
        same(codec, library, t)


def test_documents(spark, docs, rows, empty, library):
    made = piece_bpe.encode_documents(docs, PATH)
    want = Counter()
    for i, t in [*rows, (None, "no id")]:
        ids = library.encode(t or "")
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in made.collect()) == want
    back = piece_bpe.decode_documents(made, PATH)
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((i, t or "") for i, t in [*rows, (None, "no id")])
    assert piece_bpe.encode_documents(empty, PATH, with_ids=False).collect() == []
    assert piece_bpe.decode_documents(spark.createDataFrame([(1, None)], "doc_id long, ids array<long>"), PATH).collect()[0].text == ""


def test_texts_at_once_are_encoded_as_alone(codec):
    """One pass of the automaton goes through many texts; before, each text had a pass and an array of its own."""
    rng = random.Random(6)
    texts = ["", codec.encoder.between, *("".join(rng.choice("aeinrst▁é日\x00" + codec.encoder.between) for _ in range(rng.randint(0, 14))) for _ in range(2000)), ""]
    got = codec.encoder.encoded(texts)
    assert got == [codec.encoder.encode(t) for t in texts]
    assert all(codec.encoder.tokens(t) == codec.encoder.merged(t) for t in texts)


def test_few_pairs_are_remembered(library):
    encoder = piece_bpe.Encoder(piece_bpe.Model(PATH), limit=10)
    text = piece_bpe.SPACE + "remembering nothing, again".replace(" ", piece_bpe.SPACE)
    assert encoder.encode(text).tolist() == library.encode(text[1:]) and len(encoder.apart) <= 10
