"""The pair level of the toxicity models: a word given the one before it."""

import math
import random
import zlib

import numpy as np

from gallerylens.llm import toxicity

WORDS = ["ka", "lo", "mi", "nu", "total", "waste", "of", "idiot"]


def rows(n=120):
    rng = random.Random(3)
    return [(" ".join(rng.choice(WORDS[: 7 + x]) for _ in range(rng.randint(1, 25))) + " total waste" * (2 * x), x) for x in (int(rng.random() < 0.3) for _ in range(n))] + [("", 0), ("idiot", 1), ("mi only", 1)]


def brute(found):
    """{w: (p0, p1)}, {(v, w): (p0, p1)} for every v of a toxic pair and every w, the pairs that toxic texts hold, and what each v gives to the words."""
    heads, befores = {}, {}
    for text, c in found:
        w = [None, *text.split()]
        for k in range(1, len(w)):
            heads.setdefault(w[k], [set(), set()])[c].add(w[k - 1])
            if k > 1:
                befores.setdefault(w[k - 1], {}).setdefault(w[k], [set(), set()])[c].add(w[k - 2])

    def level(counts, discount):
        total = [max(sum(n[c] for n in counts.values()), 1) for c in range(3)]
        freed = [sum(min(n[c], discount) for n in counts.values()) / total[c] if any(n[c] for n in counts.values()) else 1 for c in range(3)]
        shared = max(freed[:2])
        scale = [(1 - shared) / (1 - f) if f < 1 else 0 for f in freed[:2]] + [1]
        return (lambda n, c: scale[c] * max(n[c] - discount, 0) / total[c]), shared, freed[2]

    sizes = lambda sets: (len(sets[0]), len(sets[1]), len(sets[0] | sets[1]))
    one = {w: sizes(s) for w, s in heads.items()}
    seen, shared, free = level(one, 0.75)
    words = {w: tuple(seen(n, c) + shared * (seen(n, 2) + free / (len(one) + 1)) for c in (0, 1)) for w, n in one.items()}
    pairs, weights = {}, {}
    for v, after in befores.items():
        two = {w: sizes(s) for w, s in after.items()}
        if any(n[1] for n in two.values()):
            seen, shared, free = level(two, 1)
            weights[v] = shared * free
            for w in words:
                n = two.get(w, (0, 0, 0))
                pairs[v, w] = tuple(seen(n, c) + shared * (seen(n, 2) + free * words[w][c]) for c in (0, 1))
    held = {(v, w) for v, after in befores.items() for w, s in after.items() if s[1]}
    return words, pairs, held, weights


def ratio(p):
    return math.log(p[1] / p[0])


def test_pairs_given_their_first_word(spark):
    found = rows()
    words, pairs, held, weights = brute(found)
    h = {w: toxicity.word_hash(w.encode()) for w in words}
    one, two = toxicity.given_expressions(spark.createDataFrame(found, "text string, toxic int").repartition(3))
    got = {r.w: (r.p0, r.p1) for r in one.collect()}
    assert got.keys() == {h[w] for w in words} and all(np.allclose(got[h[w]], p, rtol=1e-12) for w, p in words.items())
    got = {(r.v, r.w): r for r in two.collect()}
    assert got.keys() == {(h[v], h[w]) for v, w in held}
    assert all(np.allclose((got[h[v], h[w]].p0, got[h[v], h[w]].p1), pairs[v, w], rtol=1e-9) for v, w in held)
    assert all(abs(got[h[v], h[w]].best - max(ratio(words[v]), ratio(words[w]))) < 1e-9 for v, w in held)
    # all that may follow a word adds up to 1 with what the words leave to the unseen, in both classes and for each first word by itself
    left = [1 - sum(p[c] for p in words.values()) for c in (0, 1)]
    assert len(set(weights.values())) > 1 and all(math.isclose(sum(pairs[v, w][c] for w in words) + weight * left[c], 1) for v, weight in weights.items() for c in (0, 1))
    # what toxic texts do not hold is never a text's strongest
    assert all(ratio(p) <= max(ratio(words[w]), 0) + 1e-9 for (v, w), p in pairs.items() if (v, w) not in held)


def test_training_and_scores(spark):
    """`train` weighs by these figures, and a text's strongest word is taken over all words, alone or given the one before."""
    found = rows(300)
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(found)], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(i, x) for i, (_, x) in enumerate(found)], "doc_id long, toxic int"))
    words, pairs, *_ = brute([x for i, x in enumerate(found) if zlib.crc32(str(i).encode()) % 5 > 1])
    assert ratio(pairs["total", "waste"]) > max(ratio(words["total"]), ratio(words["waste"]), 0)
    scored = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, model).collect()}
    for i, (text, _) in enumerate(found):
        w = text.split()
        x = max([0, *(ratio(words[a]) for a in w if a in words), *(ratio(pairs[p]) for p in zip(w, w[1:], strict=False) if p in pairs)])
        assert abs(scored[i] - 1 / (1 + math.exp(-(model.intercept + model.slope * x)))) < 1e-9
