"""Abbreviations against counting by hand, and where texts are cut."""

import math
import re
from collections import Counter

import pyarrow as pa

from gallerylens.operators import sentences

TEXTS = [
    "He paints, e.g. in oil. The museum owns it, i.e. the city. Dr. Weber saw it in Nov. at home.",
    "We met Dr. Klein (e.g. at noon). Was it so? It was! Prints etc. are sold.",
    "See e.g. the frame. Dr. Weber left. \"It is done.\" She went home. Prices etc. fell, cf. the list.",
    "The colours, e.g. red, fade. No. It is cf. a copy. Dr. Roth came. J. S. Bach played. It cost 3. marks.",
] * 4 + [None, "", " \n ", "No mark at all", "One.\nTwo.   Three", "The oil dried"]


def counted(texts):
    full = Counter()
    for t in texts:
        for w in re.split(r"\s+", (t or "").lower()):
            w = re.sub(sentences._STRIP, "", w)
            if any(c.isalpha() for c in w):
                full[w] += 1
    out = {}
    for w, n in full.items():
        own = out.setdefault(w.removesuffix("."), [0, 0])
        own[not w.endswith(".")] += n
    return out


def test_abbreviations(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").repartition(3)
    want = counted(TEXTS)
    assert {r.word: [r["with"], r.without] for r in sentences.word_counts(docs).collect()} == want
    dots, total = sum(a for a, _ in want.values()), sum(map(sum, want.values()))
    score = {}
    for w, (a, b) in want.items():
        if a:
            plain, inner = len(w.replace(".", "")), w.count(".")
            ratio = -2 * (a * math.log(dots / total) + b * math.log(1 - dots / total) - a * math.log(0.99) - b * math.log(0.01))
            score[w] = ratio * math.exp(-plain) * (inner + 1) * plain**-b
    got = {r.word: r.score for r in sentences.abbreviations(docs).collect()}
    assert got.keys() == {w for w, s in score.items() if s >= 0.3} and all(math.isclose(got[w], score[w]) for w in got)
    assert {"e.g", "dr", "etc", "cf"} <= got.keys() and not {"oil", "home", "it", "city"} & got.keys()
    assert sentences.abbreviations(docs.limit(0)).count() == 0


def test_sentences(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    got = {r.doc_id: r.sentences for r in sentences.sentences(docs, sentences.abbreviations(docs)).collect()}
    assert got[0] == ["He paints, e.g. in oil.", "The museum owns it, i.e. the city.", "Dr. Weber saw it in Nov. at home."]
    assert got[1] == ["We met Dr. Klein (e.g. at noon).", "Was it so?", "It was!", "Prints etc. are sold."]
    assert got[2][2:4] == ['"It is done."', "She went home."]
    assert got[3][-3:] == ["Dr. Roth came.", "J. S. Bach played.", "It cost 3. marks."]
    assert [got[i] for i in range(16, 21)] == [[], [], [], ["No mark at all"], ["One.", "Two.", "Three"]]
    for i, own in got.items():  # nothing but white space is lost
        assert "".join("".join(own).split()) == "".join((TEXTS[i] or "").split())


def test_few_texts_are_split_at_a_time():
    """A whole batch of texts and all their sentences were held at once."""
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(["One here. Two here."] * 1000)], ["i", "t"])
    got = list(sentences._split_all([batch], frozenset(), "doc_id"))
    assert max(b.num_rows for b in got) <= sentences.ROWS < 1000
    assert pa.Table.from_batches(got).to_pydict() == {"doc_id": list(range(1000)), "sentences": [["One here.", "Two here."]] * 1000}
