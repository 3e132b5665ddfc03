"""Quality rules in DataFrame operations: counts in a text, and its distance from its language's distributions.

A document's histogram over character classes, and over the commonest words of its language and all others,
are compared with the same histograms summed over all documents of that language, by Jensen-Shannon distance.
A histogram of few characters or words is noisy: under GUARD_CHARS characters or GUARD_WORDS words it is not
compared, and each histogram has a guard of its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .common import stored

WHITE_RE = r"[\x20\x09-\x0D]+"
SYMBOLS_RE = r"[#*$%&|<>]"
#: Thirty of the commonest words of each language.
COMMON_WORDS = {
    "en": "the of and to in is that for it with as was on be at by this had not are but from or have an they which one you were".split(),
    "fr": "de la le et les des en un une que est pour qui dans par plus pas au sur se ne ce il sont avec son du elle ou mais".split(),
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird".split(),
    "es": "de la que el en y los se del las un por con no una su para es al lo como más o pero sus le ha me si sin".split(),
}
N_COMMON = 30
#: Character classes counted by pattern; white space and all other characters are two more.
CLASSES = {"upper": "[A-Z]", "lower": "[a-z]", "digit": "[0-9]", "mark": r"[.,;:!?'\"()\-]", "symbol": SYMBOLS_RE}
MIN_WORDS, GUARD_WORDS, GUARD_CHARS, MAX_CHARS, MAX_WORDS = 50, 100, 400, 0.35, 0.5


def _bound(value: Column, use) -> Column:
    """use(value) with value computed once, however often use refers to it."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, WHITE_RE), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """How many words lie in 3-word windows found twice or more among words, the first find included."""

    def exact(w: Column) -> Column:
        # neighbours in sorted order show which windows are repeated
        rows = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.concat_ws(" ", w[i], w[i + 1], w[i + 2]).alias("s"), i.alias("i"))))
        twice = lambda s: F.filter(s, lambda x, k: (x["s"] == F.get(s, k - 1)["s"]) | (x["s"] == F.get(s, k + 1)["s"]))
        found = _bound(rows, lambda s: F.transform(twice(s), lambda x: x["i"]))
        return F.size(F.array_distinct(F.flatten(F.transform(found, lambda i: F.array(i, i + 1, i + 2)))))

    def count(w: Column) -> Column:
        # equal windows have equal hashes: without two equal hashes nothing is repeated
        hashes = F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))).otherwise(F.array().cast("array<bigint>"))
        return F.when(_bound(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h)), F.lit(0)).otherwise(exact(w))

    return _bound(words, count).cast("long")


def text_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per document the base counts, and the histograms chars and words (arrays of doubles)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.expr(f"try_cast(`{id_col}` AS bigint)").alias("doc_id"), text.alias("text"), F.coalesce(F.col(lang_col), F.lit("")).alias("lang"))
    df = df.withColumn("w", words_of(F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    common = F.array().cast("array<string>")
    for lang, listed in COMMON_WORDS.items():
        common = F.when(F.col("lang") == lang, F.regexp_extract_all(F.lower("text"), F.lit(rf"(?<![^\x00-\x40\x5B-\x60\x7B-\x7F])({'|'.join(listed)})(?![^\x00-\x40\x5B-\x60\x7B-\x7F])"), F.lit(1))).otherwise(common)
    places = F.lit(None).cast("array<string>")
    for lang, listed in COMMON_WORDS.items():
        places = F.when(F.col("lang") == lang, F.array(*map(F.lit, listed))).otherwise(places)
    # each common word between spaces of its own: how much shorter the string is without a word tells how often it occurs
    spaced = F.concat(F.lit(" "), F.array_join(common, "  "), F.lit(" "))
    counted_in = lambda c, p: ((F.octet_length(c) - F.octet_length(F.replace(c, F.concat(F.lit(" "), p, F.lit(" ")), F.lit("")))) / (F.octet_length(p) + 2)).cast("double")
    df = df.select(
        "doc_id", "lang", F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.length("text").cast("long").alias("n_chars"), *(F.regexp_count("text", F.lit(p)).cast("long").alias(f"n_{c}") for c, p in CLASSES.items()),
        _bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"), repeated_words(F.col("w")).alias("n_repeat_words"),
        _bound(spaced, lambda c: F.transform(places, lambda p: counted_in(c, p))).alias("hits"),
    )
    counted = [F.col(f"n_{c}") for c in CLASSES] + [F.col("n_chars") - F.col("word_chars")]
    rest = F.col("n_chars") - reduce(lambda a, b: a + b, counted)
    other = F.greatest(F.col("n_words").cast("double") - F.aggregate("hits", F.lit(0.0), lambda a, x: a + x), F.lit(0.0))
    return df.select("doc_id", "lang", "n_chars", "n_words", "word_chars", F.col("n_symbol").alias("n_symbols"), "n_dup_lines", "n_repeat_words", F.array(*(c.cast("double") for c in [*counted, rest])).alias("chars"), F.when(F.col("hits").isNotNull(), F.concat("hits", F.array(other))).alias("words"))


def js_distance(p: Column, q: Column) -> Column:
    """The Jensen-Shannon distance (base 2) of two histograms of one length; null where either is null or sums to zero."""

    def share(x: Column) -> Column:
        return _bound(x, lambda a: _bound(F.aggregate(a, F.lit(0.0), lambda s, v: s + v), lambda t: F.transform(a, lambda v: F.try_divide(v, t))))

    def term(a: Column, m: Column) -> Column:
        return F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)

    def half(a: Column, b: Column) -> Column:
        return F.zip_with(a, b, lambda x, y: term(x, (x + y) / 2) + term(y, (x + y) / 2))

    return F.sqrt(F.greatest(F.aggregate(half(share(p), share(q)), F.lit(0.0), lambda s, v: s + v) / 2, F.lit(0.0)))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_chars: float = MAX_CHARS, max_words: float = MAX_WORDS, guard_chars: int = GUARD_CHARS, guard_words: int = GUARD_WORDS) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, chars_distance, words_distance.

    Fails at the base: under 50 words, or over half of them in repeated 3-word windows.  Of the others those
    stay whose distances from the language's histograms, summed over all documents of it that pass the base,
    are at most max_chars and max_words; of fewer than guard_chars characters, or guard_words words, the one or the
    other is not compared.  A null text is empty; a null language is one of its own, without common words.
    Repeated rows, and rows without an id, are each judged; an empty table gives an empty result.
    """
    features = stored(text_features(docs, id_col, text_col, lang_col), "features")
    features = features.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    sums = lambda name, n: F.array(*(F.sum(F.get(F.col(name), F.lit(i))) for i in range(n)))
    reference = features.where("not base_failed").groupBy("lang").agg(sums("chars", len(CLASSES) + 2).alias("ref_chars"), F.when(F.count("words") > 0, sums("words", N_COMMON + 1)).alias("ref_words"))
    judged = features.join(reference, "lang", "left").withColumn("chars_distance", js_distance(F.col("chars"), F.col("ref_chars"))).withColumn("words_distance", js_distance(F.col("words"), F.col("ref_words")))
    judged = judged.withColumns({"chars_distance": F.when(F.col("n_chars") >= guard_chars, F.col("chars_distance")), "words_distance": F.when(F.col("n_words") >= guard_words, F.col("words_distance"))})
    near = (F.coalesce("chars_distance", F.lit(0.0)) <= max_chars) & (F.coalesce("words_distance", F.lit(0.0)) <= max_words)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & near).alias("kept"), "chars_distance", "words_distance")
