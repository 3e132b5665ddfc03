"""Metrics of generated texts against references: rows (id, hyp) and (id, ref_no, ref)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as X
from ..functions.stems import stem


def ngrams(tokens: Column, n: int) -> Column:
    size = F.size(tokens)
    return F.when(size >= n, F.transform(F.sequence(F.lit(0), size - n), lambda i: F.array_join(F.slice(tokens, i + 1, n), " "))).otherwise(F.array().cast("array<string>"))


def _counts(df: DataFrame, keys: list[str], text: str, sizes: Iterable[int]) -> DataFrame:
    """(keys, n, g, c): how often each n-gram of the sizes occurs; texts are cut into words once."""
    sized = lambda n: F.transform(ngrams(F.col("_t"), n), lambda g: F.struct(F.lit(n).alias("n"), g.alias("g")))
    grams = df.select(*keys, X.tokens(F.col(text)).alias("_t")).select(*keys, F.explode(F.flatten(F.array(*map(sized, sizes)))).alias("x")).select(*keys, "x.n", "x.g")
    return grams.groupBy(*keys, "n", "g").agg(F.count("*").alias("c"))


def bleu(hyps: DataFrame, refs: DataFrame, order: int = 4) -> DataFrame:
    """One row: corpus BLEU-1 to BLEU-4 with counts clipped by the largest of any reference and the closest reference length."""
    sizes = range(1, order + 1)
    h_len = hyps.select("id", F.size(X.tokens(F.col("hyp"))).alias("h"))
    r_len = refs.select("id", F.size(X.tokens(F.col("ref"))).alias("r"))
    closest = h_len.join(r_len, "id").groupBy("id", "h").agg(F.min_by("r", F.struct(F.abs(F.col("r") - F.col("h")), "r")).alias("r"))
    lengths = closest.agg(F.sum("h").alias("H"), F.sum("r").alias("R"))
    most = _counts(refs, ["id", "ref_no"], "ref", sizes).groupBy("id", "n", "g").agg(F.max("c").alias("m"))
    own = _counts(hyps.join(refs.select("id").distinct(), "id", "left_semi"), ["id"], "hyp", sizes).join(most, ["id", "n", "g"], "left")
    of = lambda c, n: F.sum(F.when(F.col("n") == n, c))
    clipped = own.agg(*(x for n in sizes for x in (of(F.least("c", F.coalesce("m", F.lit(0))), n).alias(f"m{n}"), of(F.col("c"), n).alias(f"t{n}"))))
    short = F.when(F.col("H") < F.col("R"), F.exp(1 - F.col("R") / F.col("H"))).otherwise(1.0)
    logs = [F.log(F.greatest(F.coalesce(F.try_divide(F.col(f"m{n}"), F.col(f"t{n}")), F.lit(0.0)), F.lit(1e-12))) for n in sizes]
    return lengths.crossJoin(clipped).select(*(F.round(short * F.exp(reduce(lambda a, b: a + b, logs[:n]) / n), 6).alias(f"bleu{n}") for n in sizes))  # one row each


def rouge_n(hyps: DataFrame, refs: DataFrame, sizes: Iterable[int]) -> DataFrame:
    """(id, n, rouge): the largest F1 of shared n-grams over the references, for each n of sizes."""
    hc, rc = _counts(hyps, ["id"], "hyp", sizes), _counts(refs, ["id", "ref_no"], "ref", sizes)
    shared = rc.join(hc.withColumnRenamed("c", "hc"), ["id", "n", "g"], "left").groupBy("id", "ref_no", "n").agg(F.sum(F.least("c", F.coalesce("hc", F.lit(0)))).alias("s"), F.sum("c").alias("r"))
    grid = refs.select("id", "ref_no", F.explode(F.array(*map(F.lit, sizes))).alias("n"))
    pairs = grid.join(hc.groupBy("id", "n").agg(F.sum("c").alias("h")), ["id", "n"], "left").join(shared, ["id", "ref_no", "n"], "left")
    f1 = F.coalesce(F.try_divide(2.0 * F.coalesce("s", F.lit(0)), F.coalesce("h", F.lit(0)) + F.coalesce("r", F.lit(0))), F.lit(0.0))
    return pairs.groupBy("id", "n").agg(F.round(F.max(f1), 6).alias("rouge"))


def _lcs(a: list[str], b: list[str]) -> int:
    """The length of the longest common subsequence, by bit-parallel rows."""
    places: dict[str, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for w in b:
        hit = row & places.get(w, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def rouge_l(hyps: DataFrame, refs: DataFrame, beta: float = 1.2) -> DataFrame:
    """(id, rouge_l): from the best precision and the best recall over the references."""

    @F.pandas_udf("long")
    def lcs(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([_lcs(list(a), list(b)) for a, b in zip(x, y, strict=True)])

    h, r = X.tokens(F.col("hyp")), X.tokens(F.col("ref"))
    pairs = hyps.join(refs, "id").select("id", h.alias("h"), r.alias("r")).withColumn("l", lcs("h", "r"))
    pr = pairs.groupBy("id").agg(F.max(F.coalesce(F.try_divide(F.col("l"), F.size("h")), F.lit(0.0))).alias("p"), F.max(F.coalesce(F.try_divide(F.col("l"), F.size("r")), F.lit(0.0))).alias("r"))
    b2 = beta * beta
    return pr.select("id", F.round(F.coalesce(F.try_divide((1 + b2) * F.col("p") * F.col("r"), F.col("r") + b2 * F.col("p")), F.lit(0.0)), 6).alias("rouge_l"))


def rouge_lsum(hyps: DataFrame, refs: DataFrame) -> DataFrame:
    """(id, rouge_lsum): the largest F1 over the references of the words that a sentence of the reference shares, in order, with any sentence of the hypothesis.

    Sentences are lines.  Of a reference's sentence the words of its longest common subsequences with each of the
    hypothesis's are taken together; a word counts at most as often as in either text.
    """

    @F.pandas_udf("double")
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([_lsum(a, b) for a, b in zip(x, y, strict=True)])

    scored = hyps.join(refs, "id").select("id", score("hyp", "ref").alias("s"))
    return scored.groupBy("id").agg(F.round(F.max("s"), 6).alias("rouge_lsum"))


def _common(a: list[str], b: list[str]) -> set[int]:
    """The places in a of one longest common subsequence with b."""
    rows = [[0] * (len(b) + 1)]
    for w in a:
        last, row = rows[-1], [0]
        for k, v in enumerate(b):
            row.append(last[k] + 1 if w == v else max(last[k + 1], row[-1]))
        rows.append(row)
    i, j, out = len(a), len(b), set()
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.add(i)
        elif rows[i][j - 1] > rows[i - 1][j]:
            j -= 1
        else:
            i -= 1
    return out


def _lsum(hyp: str | None, ref: str | None) -> float:
    cut = lambda text: [w for line in (text or "").lower().split("\n") if (w := line.split())]
    h, r = cut(hyp), cut(ref)
    left, free = Counter(w for x in h for w in x), Counter(w for x in r for w in x)
    hits = 0
    for sentence in r:
        for k in sorted(set().union(*(_common(sentence, x) for x in h)) if h else ()):
            w = sentence[k]
            if left[w] > 0 and free[w] > 0:
                hits, left[w], free[w] = hits + 1, left[w] - 1, free[w] - 1
    n, m = sum(map(len, h)), sum(map(len, r))
    return 2 * hits / (n + m) if n + m else 0.0


def cider(hyps: DataFrame, refs: DataFrame, order: int = 4) -> DataFrame:
    """(id, cider): ten times the mean over n of the mean over references of the tf-idf cosine of n-grams."""
    sizes = range(1, order + 1)
    total = refs.select("id").distinct().agg(F.log(F.count("*").cast("double")).alias("logn"))  # one row
    rc, hc = _counts(refs, ["id", "ref_no"], "ref", sizes), _counts(hyps, ["id"], "hyp", sizes)
    df = rc.select("id", "n", "g").distinct().groupBy("n", "g").agg(F.count("*").alias("df"))
    weigh = lambda x: x.join(df, ["n", "g"], "left").crossJoin(F.broadcast(total)).withColumn("w", F.col("c") * (F.col("logn") - F.log(F.greatest(F.coalesce("df", F.lit(0)), F.lit(1)).cast("double"))))
    rw, hw = weigh(rc).select("id", "ref_no", "n", "g", F.col("w").alias("rw")), weigh(hc).select("id", "n", "g", F.col("w").alias("hw"))
    h_norm = hw.groupBy("id", "n").agg(F.sqrt(F.sum(F.col("hw") * F.col("hw"))).alias("hn"))
    dots = rw.join(hw, ["id", "n", "g"], "left").groupBy("id", "ref_no", "n").agg(F.sqrt(F.sum(F.col("rw") * F.col("rw"))).alias("rn"), F.sum(F.col("rw") * F.coalesce("hw", F.lit(0.0))).alias("d"))
    grid = refs.select("id", "ref_no", F.explode(F.array(*map(F.lit, sizes))).alias("n"))
    sims = grid.join(h_norm, ["id", "n"], "left").join(dots, ["id", "ref_no", "n"], "left").select("id", "n", F.coalesce(F.try_divide(F.col("d"), F.col("rn") * F.col("hn")), F.lit(0.0)).alias("s"))
    return sims.groupBy("id", "n").agg(F.avg("s").alias("s")).groupBy("id").agg(F.round(10 * F.sum("s") / order, 5).alias("cider"))


def meteor_exact(hyps: DataFrame, refs: DataFrame, alpha: float = 0.9, beta: float = 3.0, gamma: float = 0.5) -> DataFrame:
    """(id, meteor): the best over the references, with exact matches only (no stems or synonyms)."""

    @F.pandas_udf("double")
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        def one(h: list[str], r: list[str]) -> float:
            free: dict[str, list[int]] = {}
            for i in range(len(r) - 1, -1, -1):
                free.setdefault(r[i], []).append(i)
            found = [(i, free[w].pop()) for i, w in enumerate(h) if free.get(w)]
            if not found:
                return 0.0
            p, q = len(found) / len(h), len(found) / len(r)
            chunks = 1 + sum(a[0] + 1 != b[0] or a[1] + 1 != b[1] for a, b in zip(found, found[1:], strict=False))
            return p * q / (alpha * p + (1 - alpha) * q) * (1 - gamma * (chunks / len(found)) ** beta)

        return pd.Series([one(list(a), list(b)) for a, b in zip(x, y, strict=True)])

    pairs = hyps.join(refs, "id").select("id", score(X.tokens(F.col("hyp")), X.tokens(F.col("ref"))).alias("m"))
    return pairs.groupBy("id").agg(F.round(F.max("m"), 6).alias("meteor"))


#: Partial matchings that are kept from word to word, all of them for texts of at most SHORT words each; longer ones keep as many as the metric's own search does.
SHORT, MATCHINGS, WAYS = 12, 40, 5


def _places(free: int, last: int, every: bool) -> list[int]:
    """The places whose bits are set: all, or the first ones and the one that goes on from the last."""
    out = [last + 1] if last >= -1 and free >> last + 1 & 1 else []
    while free and (every or len(out) < WAYS):
        j = (free & -free).bit_length() - 1
        free &= free - 1
        if j not in out:
            out.append(j)
    return out


def aligned(hyp: list[str], ref: list[str], given: dict[int, int]) -> dict[int, int]:
    """given, places of hyp with places of ref, and as many more of equal words as there are, with fewest crossings, of these with fewest chunks.

    Words are matched from the left: what counts of a partial matching is which words of ref it has taken, and the last
    one, so that of matchings alike in that only the best goes on.
    """
    free: dict[str, int] = {}
    for j, w in enumerate(ref):
        if j not in given.values():
            free[w] = free.get(w, 0) | 1 << j
    after, short = Counter(w for i, w in enumerate(hyp) if i not in given), max(len(hyp), len(ref)) <= SHORT
    need = {w: min(after[w], own.bit_count()) for w, own in free.items()}
    states: dict[tuple[int, int], tuple[int, int, tuple]] = {(0, -2): (0, 0, ())}
    for i, w in enumerate(hyp):
        own = free.get(w, 0) if i not in given else 0
        after[w] -= i not in given
        new: dict[tuple[int, int], tuple[int, int, tuple]] = {}
        for (taken, last), (crossings, chunks, pairs) in states.items():
            ways = [given[i]] if i in given else _places(own & ~taken, last, short)
            if i not in given and (taken & own).bit_count() + after[w] >= need.get(w, 0):
                ways.append(-2)
            for j in ways:
                to = (taken, -2) if j < 0 else (taken | 1 << j, j)
                cost = (crossings, chunks, pairs) if j < 0 else (crossings + (taken >> j + 1).bit_count(), chunks + (j != last + 1), (*pairs, (i, j)))
                if to not in new or cost < new[to]:
                    new[to] = cost
        states = dict(sorted(new.items(), key=lambda x: x[1])[: None if short else MATCHINGS])
    return dict(min(states.values())[2]) if states else {}


def meteor(hyps: DataFrame, refs: DataFrame, alpha: float = 0.9, beta: float = 3.0, gamma: float = 0.5, stems: float = 0.6) -> DataFrame:
    """(id, meteor): the best over the references, words matched as they are, then by their stems, which count for less; no synonyms.

    An empty text scores 0.
    """

    @F.pandas_udf("double")
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        def one(h: list[str], r: list[str]) -> float:
            same = aligned(h, r, {})
            found = aligned([*map(stem, h)], [*map(stem, r)], same)
            if not found:
                return 0.0
            weight = len(same) + stems * (len(found) - len(same))
            p, q = weight / len(h), weight / len(r)
            pairs = sorted(found.items())
            chunks = 1 + sum(a[0] + 1 != b[0] or a[1] + 1 != b[1] for a, b in zip(pairs, pairs[1:], strict=False))
            return p * q / (alpha * p + (1 - alpha) * q) * (1 - gamma * (chunks / len(found)) ** beta)

        return pd.Series([one(list(a), list(b)) for a, b in zip(x, y, strict=True)])

    pairs = hyps.join(refs, "id").select("id", score(X.tokens(F.col("hyp")), X.tokens(F.col("ref"))).alias("m"))
    return pairs.groupBy("id").agg(F.round(F.max("m"), 6).alias("meteor"))


def robust_accuracy(rows: DataFrame) -> DataFrame:
    """(id, score) of rows (id, pred, refs array): matches over min(references, 3), at most 1, after normalising both."""
    p = F.transform(F.array(X.robust_answer(F.col("pred"))), lambda p: F.size(F.filter(F.transform("refs", lambda r: X.robust_answer(r)), lambda r: r == p)))[0]
    return rows.select("id", F.least(F.coalesce(F.try_divide(p.cast("double"), F.least(F.size("refs"), F.lit(3))), F.lit(0.0)), F.lit(1.0)).alias("score"))


def pairs(hyps: DataFrame, refs: DataFrame) -> DataFrame:
    """(id, hyp, n_refs, refs): hypotheses that are not blank with their references in order; without references dropped."""
    listed = refs.where("ref is not null and trim(ref) != ''").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("ref_no", "ref"))).alias("xs"))
    return hyps.where("hyp is not null and trim(hyp) != ''").join(listed, "id").select("id", "hyp", F.size("xs").alias("n_refs"), F.array_join(F.transform("xs", lambda x: x["ref"]), "|").alias("refs"))


def last_turns(conv: DataFrame, key: str, turn: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(key).orderBy(F.col(turn).desc()))
    return conv.withColumn("_n", n).where("_n = 1").drop("_n")


def vocabulary(refs: DataFrame, text: str) -> DataFrame:
    """(token): the distinct words of the references, without punctuation."""
    return refs.select(F.explode(X.words(X.without_punctuation(F.col(text)))).alias("token")).distinct()


def in_vocabulary(rows: DataFrame, keys: list[str], text: str, vocab: DataFrame, most: int) -> DataFrame:
    """(keys, text): the words that without punctuation are tokens of vocab, as they stand, the first `most` of them; a cut text keeps its final period."""
    said = rows.select(*keys, F.posexplode(X.words(F.col(text))).alias("_pos", "_word")).withColumn("token", X.without_punctuation(F.col("_word")))
    kept = said.join(vocab, "token", "left_semi").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_pos", "_word"))).alias("_xs"))
    whole = F.array_join(F.transform("_xs", lambda x: x["_word"]), " ")
    return kept.select(*keys, X.truncate_words(whole, most).alias(text))
