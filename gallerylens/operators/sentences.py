"""Sentence boundaries by abbreviations that are learnt from the texts themselves.

A word that nearly always has a period after it is an abbreviation.  For each word the counts with and without a period
are compared by the likelihood ratio of two accounts: that the period comes as often as after any word, and that it
comes nearly always; short words, words with inner periods and words never seen without one weigh more.  Counting is
one aggregation over all texts; a text is then cut after marks that end a sentence, but not after an abbreviation, an
initial or a number with a period unless a sentence clearly begins.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: How often an abbreviation has its period, and from which score on a word is one.
NEARLY, LEAST = 0.99, 0.3
#: So many abbreviations may be shipped; they are short, so that a language has few.
MOST = 200_000
#: Texts that a task splits at a time.
ROWS = 256
_STRIP = r"""^["'(\[{«“‘„]+|["')\]}»”’,;:!?]+$"""
_END = re.compile(r"""([.!?…]+)(["')\]»”’]*)(\s+)""")
_WORD = re.compile(r"""["'(\[{«“‘„]*(\S*)$""")


def words(text: Column) -> Column:
    """What stands between white space, small, without quotes, brackets and marks around it; the period at its end stays."""
    cut = F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: F.regexp_replace(w, _STRIP, ""))
    return F.filter(cut, lambda w: F.regexp_like(w, F.lit(r"\p{L}")))


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, with, without): how often each word has a period after it, and how often none."""
    each = docs.select(F.explode(words(F.col(text))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    dot = F.col("w").endswith(".")
    return each.groupBy(F.when(dot, F.expr("left(w, length(w) - 1)")).otherwise(F.col("w")).alias("word")).agg(
        F.sum(F.when(dot, F.col("n")).otherwise(0)).alias("with"), F.sum(F.when(dot, 0).otherwise(F.col("n"))).alias("without")
    )


def abbreviations(docs: DataFrame, text: str = "text", least: float = LEAST) -> DataFrame:
    """(word, score) of the words that the texts use as abbreviations, without their last period.

    An empty table, and one without periods, has none.
    """
    counts = word_counts(docs, text)
    total = counts.agg(F.sum("with").alias("dots"), F.sum(F.col("with") + F.col("without")).alias("all"))
    both = counts.where("`with` > 0 AND word != ''").crossJoin(F.broadcast(total))  # one row
    log = lambda x: F.log(F.greatest(x, F.lit(1e-300)))
    p = F.col("dots") / F.col("all")
    usual = F.col("with") * log(p) + F.col("without") * log(1 - p)
    nearly = F.col("with") * math.log(NEARLY) + F.col("without") * math.log(1 - NEARLY)
    inner = F.length("word") - F.length(F.replace("word", F.lit("."), F.lit("")))
    plain = F.length("word") - inner
    score = -2 * (usual - nearly) * F.exp(-plain) * (inner + 1) * F.pow(plain.cast("double"), -F.col("without").cast("double"))
    return both.select("word", score.alias("score")).where(F.col("score") >= least)


def split(text: str, known: frozenset[str]) -> list[str]:
    """The sentences of a text; an abbreviation is never the end of one before a small letter, nor before a capital one unless it is long enough to be a word too."""
    out, start = [], 0
    for m in _END.finditer(text):
        after = text[m.end() : m.end() + 2].lstrip("\"'([{«“‘„¿¡")[:1]
        if m[1] == "." and not m[2]:
            word = _WORD.search(text, max(start, m.start() - 80), m.start())[1].lower()
            if word in known or (len(word) == 1 and word.isalpha()) or (word.isdigit() and after.islower()):
                continue
        if m[1] in ".…" and after.islower():
            continue
        out.append(text[start : m.end(2)])
        start = m.end()
    rest = text[start:].rstrip()
    return out + [rest] if rest else out


def _split_all(batches, known: frozenset[str], id_col: str):
    for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
        found = [split(t.strip(), known) if t else [] for t in batch.column("t").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array(found, pa.list_(pa.string()))], [id_col, "sentences"])


def sentences(docs: DataFrame, known: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id_col, sentences) of every row: known are `abbreviations`, learnt on these or other texts.

    A null, empty or white text has no sentence; the text of a sentence is unchanged, without white space around it.
    """
    held = [r[0] for r in known.select("word").limit(MOST + 1).collect()]
    if len(held) > MOST:
        raise ValueError(f"more than {MOST} abbreviations")
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(held))

    return docs.select(F.col(id_col).alias("i"), F.col(text).alias("t")).mapInArrow(lambda it: _split_all(it, shared.value, id_col), f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, sentences array<string>")
