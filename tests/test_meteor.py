"""Stems by the examples of the algorithm's paper; matchings by exhaustive search."""

import itertools
import random

from gallerylens.functions.stems import stem
from gallerylens.operators import textmetrics

STEMS = "caresses caress|ponies poni|ties ti|cats cat|feed feed|agreed agre|plastered plaster|bled bled|motoring motor|sing sing|conflated conflat|troubled troubl|sized size|hopping hop|tanned tan|falling fall|hissing hiss|fizzed fizz|failing fail|filing file|happy happi|sky sky|relational relat|conditional condit|rational ration|valenci valenc|digitizer digit|radicalli radic|vietnamization vietnam|operator oper|feudalism feudal|decisiveness decis|hopefulness hope|formaliti formal|sensibiliti sensibl|triplicate triplic|formative form|electrical electr|goodness good|revival reviv|allowance allow|inference infer|airliner airlin|adjustable adjust|replacement replac|adoption adopt|homologou homolog|communism commun|activate activ|effective effect|bowdlerize bowdler|probate probat|rate rate|cease ceas|controll control|roll roll"


def test_stems():
    assert {w: stem(w) for w, _ in (x.split() for x in STEMS.split("|"))} == dict(x.split() for x in STEMS.split("|"))
    assert [stem(w) for w in ("is", "café", "3s", "")] == ["is", "café", "3s", ""]


def exhaustive(h, r, given):
    free_h, free_r = [i for i in range(len(h)) if i not in given], [j for j in range(len(r)) if j not in given.values()]
    best = None
    for n in range(min(len(free_h), len(free_r)), -1, -1):
        for rows in itertools.combinations(free_h, n):
            for cols in itertools.permutations(free_r, n):
                if all(h[i] == r[j] for i, j in zip(rows, cols, strict=True)):
                    pairs = sorted([*given.items(), *zip(rows, cols, strict=True)])
                    crossings = sum(a[1] > b[1] for a, b in itertools.combinations(pairs, 2))
                    chunks = sum(k == 0 or (p[0] - 1, p[1] - 1) != pairs[k - 1] for k, p in enumerate(pairs))
                    best = min(best or (crossings, chunks), (crossings, chunks))
        if best is not None:
            return n + len(given), best


def test_matchings_equal_the_exhaustive_search():
    rng = random.Random(4)
    for _ in range(250):
        h, r = ([rng.choice("aabcd") for _ in range(rng.randint(0, 6))] for _ in range(2))
        given = {}
        if h and r and rng.random() < 0.4:
            given = {rng.randrange(len(h)): rng.randrange(len(r))}
        own = textmetrics.aligned(h, r, given)
        pairs = sorted(own.items())
        assert given.items() <= own.items() and len(set(own.values())) == len(own) and all(h[i] == r[j] for i, j in pairs if (i, j) not in given.items())
        crossings = sum(a[1] > b[1] for a, b in itertools.combinations(pairs, 2))
        chunks = sum(k == 0 or (p[0] - 1, p[1] - 1) != pairs[k - 1] for k, p in enumerate(pairs))
        assert (len(own), (crossings, chunks)) == exhaustive(h, r, given)


def test_meteor(spark):
    h = spark.createDataFrame([(1, "the cats sat on the mat"), (2, "a b c"), (3, ""), (4, "paintings of painters")], "id long, hyp string")
    r = spark.createDataFrame([(1, 0, "the cats sat on the mat"), (1, 1, "x"), (2, 0, "c b a"), (3, 0, "x"), (4, 0, "painting of painter")], "id long, ref_no long, ref string")
    got = {x.id: x.meteor for x in textmetrics.meteor(h, r).collect()}
    assert got[1] == round(1 - 0.5 / 6**3, 6) and got[2] == 0.5 and got[3] == 0
    weight = (1 + 2 * 0.6) / 3
    assert abs(got[4] - weight * (1 - 0.5 / 27)) < 1e-6
    long = spark.createDataFrame([(1, "the a " * 300)], "id long, hyp string"), spark.createDataFrame([(1, 0, "a the " * 300)], "id long, ref_no long, ref string")
    assert 0.4 < textmetrics.meteor(*long).first().meteor <= 1
