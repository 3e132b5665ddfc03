"""Toxicity by class-conditional Kneser-Ney models of words and pairs of words.

One model is counted over the toxic and one over the ordinary labelled texts.  As in Kneser and Ney's lower orders,
an expression counts by its contexts: a word by how many different words it follows, a pair of words by how many
different words it follows.  Copies and repeated lines so add nothing.  Each model discounts its counts and gives
what that frees to a backoff that the classes share:

* of a word w: P_c(w) = s_c max(n_c(w) - D, 0) / N_c + f P(w), P from the contexts in either class; words that these
  do not have get an equal part of what P frees itself.
* of a word w after v: P_c(w | v) = s_c(v) max(n_c(vw) - 1, 0) / N_c(v) + f(v) (max(n(vw) - 1, 0) / N(v) + g(v) P_c(w)),
  N_c(v) and N(v) the contexts of all pairs that begin with v, so that it falls back on what either class has of the
  pair, and then on the class's words, by weights of v's own.  They sum to 1 over w, whatever v is.

The freed mass f, of a level of words or of a v, is the larger of the classes' own, for both, and s_c makes up for it:
what neither class has seen tells nothing, and rare expressions tell little, as their shared backoff outweighs them.

A text's log-likelihoods are compared over its passages, each with or without the word before it, divided by the
passage's length; the mean over a passage is never more than that of its strongest word, so the largest one is a word's,
alone or after another.  The empty passage compares as 0.  A pair that no toxic text holds never speaks more for toxic
than its second word or the empty passage, as its backoff weights are the classes' alike; all pairs count in N_c(v), but
only those that toxic texts hold have to be looked up.  The score is the logistic function of this largest length-normalised log-likelihood ratio.

`expressions` and `pair_table` weigh pairs jointly instead, P_c(vw), with one freed mass for all pairs; `fit` takes either.

Words are told apart by 64-bit hashes, in tables that grow with the corpus; every word and pair of the counted rows
is counted, however rare.  Of these only the expressions that speak for the toxic class can be a text's strongest:
they are broadcast, as many as BROADCAST_ROWS, and any others are joined with the texts that hold them.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import groups, kept, raw, stored, texts

DISCOUNT, PAIR_DISCOUNT, FOLDS, RIDGE = 0.75, 1.0, 5, 0.1
CALIBRATION_ROWS, NEAR_ROWS, BROADCAST_ROWS = 20_000, 500_000, 1_000_000
#: Bits of the bitmap of pairs that toxic texts hold, and of the one of a table's expressions: they only pass over what is not there.
PAIR_BITS, TABLE_BITS, REST_BITS = 26, 24, 26
#: Bytes of texts whose words are held at a time.
GROUP = 1 << 19
#: ASCII other than letters and digits ends a word; A-Z are lower-cased.
_TABLE = bytes(i + 32 if 65 <= i <= 90 else i if i >= 128 or 48 <= i <= 57 or 97 <= i <= 122 else 32 for i in range(256))
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD)]
#: What stands before the first word of a text.
BEGIN = 0


def word_hash(word: bytes) -> int:
    """As a signed long."""
    return xxhash.xxh3_64_intdigest(word) - (1 << 63)


def pair_hash(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The hash of an expression of two words, as signed longs."""
    x = v.view(np.uint64) * _ODD[0] + (w.view(np.uint64) ^ _ODD[1]) * _ODD[2]
    x = (x ^ (x >> np.uint64(29))) * _ODD[1]
    return (x ^ (x >> np.uint64(32))).view(np.int64)


class _Hashes(dict):
    """word -> hash; forgets all when it holds too many words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 250_000:
            self.clear()
        self[word] = found = word_hash(word)
        return found


def word_hashes(found: list[bytes], hashes: _Hashes | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of the texts, one text after the other, and how many words each has."""
    hashes = kept(("toxicity",), _Hashes) if hashes is None else hashes
    words = [t.translate(_TABLE).split() for t in found]
    sizes = np.array([len(w) for w in words], np.int64)
    return np.fromiter((hashes[x] for w in words for x in w), np.int64, int(sizes.sum())), sizes


def before(hashes: np.ndarray, sizes: np.ndarray, n: int = 1) -> np.ndarray:
    """The word n places before each, BEGIN ahead of a text."""
    out = np.full(len(hashes), BEGIN, np.int64)
    out[n:] = hashes[: max(0, len(hashes) - n)]
    start = np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.arange(len(hashes)) - n < start] = BEGIN
    return out


def _bit(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)


def _bitmap(keys: DataFrame, bits: int) -> np.ndarray:
    """A bitmap, of a size that does not depend on the data, of the first bits of the longs in column key."""
    at = F.shiftrightunsigned("key", 64 - bits)
    rows = keys.select(F.shiftright(at, 15).alias("part"), at.bitwiseAND(F.lit(32767)).alias("at")).groupBy("part").agg(F.bitmap_construct_agg("at").alias("map")).collect()
    out = np.zeros((max(1, 1 << bits - 15), 4096), np.uint8)
    for part, found in rows:
        out[part] = np.frombuffer(bytes(found), np.uint8)
    return out.reshape(-1)


def _set(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


@dataclass
class Table:
    """What is broadcast: expressions and log P(x | toxic) - log P(x | ordinary) of those that speak for toxic."""

    name: str
    keys: np.ndarray  # sorted hashes
    ratio: np.ndarray
    rest: np.ndarray | None = None  # bitmap of the expressions that are not in memory

    def _own(self) -> tuple[_Hashes, np.ndarray]:
        """Hashes of words, and whether the table may hold what begins with given bits."""

        def make() -> tuple[_Hashes, np.ndarray]:
            out = np.zeros(1 << TABLE_BITS, bool)
            out[_bit(self.keys, TABLE_BITS)] = True
            return _Hashes(), out

        return kept(("toxicity", self.name), make)

    def expressions(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(text, hash) of each word, then of each pair of words."""
        h, sizes = word_hashes(found, self._own()[0])
        of = np.repeat(np.arange(len(found)), sizes)
        inside = of[1:] == of[:-1]
        return np.concatenate([of, of[1:][inside]]), np.concatenate([h, pair_hash(h[:-1], h[1:])[inside]])

    def strongest(self, found: list[bytes]) -> np.ndarray:
        """Each text's largest ratio among the expressions in memory; 0 if it has none."""
        out = np.zeros(len(found))
        of, h = self.expressions(found)
        some = np.flatnonzero(self._own()[1][_bit(h, TABLE_BITS)])
        if len(some):
            h = h[some]
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            np.maximum.at(out, of[some], np.where(self.keys[at] == h, self.ratio[at], 0))
        return out

    def others(self, found: list[bytes]) -> list[np.ndarray]:
        """The expressions of each text that the bitmap of those not in memory does not rule out, each once."""
        of, h = self.expressions(found)
        some = _set(self.rest, _bit(h, REST_BITS))
        of, h = np.unique(np.stack([of[some], h[some]]), axis=1)
        return np.split(h, np.searchsorted(of, np.arange(1, len(found))))


@dataclass
class Model:
    table: Table
    rest: DataFrame | None = None  # (key, ratio) of the expressions that are not in memory
    intercept: float = 0.0
    slope: float = 0.0

    def scores(self):
        """The function from strongest ratios to scores in 0..1."""
        a, b = self.intercept, self.slope
        return lambda x: 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))

    def measured(self, docs: DataFrame, text: str, use, schema) -> DataFrame:
        """The batches that use(batch, strongest ratio of each text) makes of docs, by groups of texts so that the words of few are held at a time."""
        shared, at, spare = docs.sparkSession.sparkContext.broadcast(self.table), docs.columns.index(text), self.rest is not None  # at most BROADCAST_ROWS expressions

        def run(batches):
            for batch in batches:
                found = raw(batch.column(at).fill_null(""))
                x = np.concatenate([np.zeros(0), *(shared.value.strongest(found[a:b]) for a, b in groups(found, GROUP))])
                if spare:
                    x = np.maximum(x, batch.column("__ratio").fill_null(0.0).to_numpy(zero_copy_only=False))
                    batch = batch.select(batch.schema.names[:-1])
                if len(found):
                    yield use(batch, x)

        return (self._looked_up(docs, text, shared) if spare else docs).mapInArrow(run, schema)

    def _looked_up(self, docs: DataFrame, text: str, shared) -> DataFrame:
        """docs with the largest ratio that the rest has of its text; equal texts are looked up once."""

        def others(batches):
            for batch in batches:
                found = raw(batch.column("text"))
                own = [w for a, b in groups(found) for w in shared.value.others(found[a:b])]
                yield pa.RecordBatch.from_arrays([batch.column("hash"), pa.array(own, pa.list_(pa.int64()))], ["hash", "key"])

        key = F.unhex(F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")))
        own = docs.select(key.alias("hash"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).mapInArrow(others, "hash binary, key array<long>")
        found = own.select("hash", F.explode("key").alias("key")).join(self.rest, "key").groupBy("hash").agg(F.max("ratio").alias("__ratio"))
        names = [F.col(f"`{c}`") for c in docs.columns]
        return docs.withColumn("__hash", key).join(found.withColumnRenamed("hash", "__hash"), "__hash", "left").select(*names, "__ratio")


def _near(df: DataFrame, small: DataFrame, key: str) -> DataFrame:
    """df joined with small, which is broadcast only if its rows are counted to be few."""
    few = small.limit(NEAR_ROWS + 1).count() <= NEAR_ROWS
    return df.join(F.broadcast(small) if few else small, key)


def _gathered(parts, most: int = 1 << 19):
    """Columns of distinct keys with the classes they occur in, from (rows of keys, classes as bits); held back until about `most` are there."""
    held, size = [], 0

    def merged():
        keys, bits = np.concatenate([k for k, _ in held], axis=1), np.concatenate([b for _, b in held])
        order = np.lexsort(keys)
        keys = keys[:, order]
        first = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)]))
        return keys[:, first], np.bitwise_or.reduceat(bits[order], first)

    for part in parts:
        if not part[0].shape[1]:
            continue
        held.append(part)
        size += part[0].shape[1]
        if size >= most:
            held = [merged()]
            size = held[0][0].shape[1]
            if size >= most // 2:
                yield held[0]
                held, size = [], 0
    if held:
        yield merged()


def _toxic_pairs(batches):
    """The hashes of the pairs of words in texts, each once for as many as are held back."""

    def parts():
        for batch in batches:
            found = raw(batch.column("text"))
            for a, b in groups(found, GROUP):
                h, sizes = word_hashes(found[a:b])
                inside = np.arange(len(h)) > np.repeat(np.cumsum(sizes) - sizes, sizes)
                keys = pair_hash(before(h, sizes), h)[inside]
                yield keys[None], np.zeros(len(keys), np.int8)

    for keys, _ in _gathered(parts()):
        yield pa.RecordBatch.from_arrays([pa.array(keys[0])], ["key"])


def _contexts(n: int, bitmap=None):
    """Batches to (w, v, ..., classes): the distinct runs of n words that end at each word of a text, as bits of the classes that have them; with a bitmap, only of pairs in it."""

    def parts(batches):
        for batch in batches:
            found, toxic = raw(batch.column("text")), batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int8)
            for a, b in groups(found, GROUP):
                h, sizes = word_hashes(found[a:b])
                runs = np.stack([before(h, sizes, k) if k else h for k in range(n)])
                bits = np.repeat(np.left_shift(1, toxic[a:b]).astype(np.int8), sizes)
                if bitmap is not None:
                    use = (np.arange(len(h)) > np.repeat(np.cumsum(sizes) - sizes, sizes)) & _set(bitmap.value, _bit(pair_hash(runs[1], runs[0]), PAIR_BITS))
                    runs, bits = runs[:, use], bits[use]
                yield runs, bits

    def run(batches):
        for keys, bits in _gathered(parts(batches)):
            for k in range(0, keys.shape[1], 250_000):
                own = slice(k, k + 250_000)
                yield pa.RecordBatch.from_arrays([*(pa.array(c[own]) for c in keys), pa.array(bits[own])], [*"wvu"[:n], "classes"])

    return run


def _keyed(batches):
    for batch in batches:
        v, w = (batch.column(c).to_numpy(zero_copy_only=False) for c in "vw")
        yield pa.RecordBatch.from_arrays([pa.array(pair_hash(v, w)), batch.column("ratio")], ["key", "ratio"])


def _counted(contexts: DataFrame, *by: str) -> DataFrame:
    """by, and the contexts in the ordinary class, the toxic one, and either: n0, n1, n."""
    c = F.col("classes")
    return contexts.groupBy(*by).agg(F.sum(c.bitwiseAND(F.lit(1))).cast("double").alias("n0"), F.sum(F.shiftright(c, 1)).cast("double").alias("n1"), F.count("*").cast("double").alias("n"))


@dataclass
class Level:
    """Totals of one level, from its table of n0, n1, n."""

    total: list[float]
    freed: list[float]
    discount: float

    @classmethod
    def of(cls, table: DataFrame, discount: float) -> Level:
        sums = [F.coalesce(F.sum(e), F.lit(0.0)) for c in ("n0", "n1", "n") for e in (F.col(c), F.least(F.col(c), F.lit(discount)))]
        found = table.agg(*sums).first()
        total = [max(x, 1.0) for x in found[0::2]]
        return cls(total, [x / t for x, t in zip(found[1::2], total, strict=True)], discount)

    @property
    def shared(self) -> float:
        """The mass that both classes give to the backoff."""
        return min(max(self.freed[:2]), 1.0)

    def seen(self, n: Column, c: int) -> Column:
        """The part of class c, or of either (2), that its own contexts give."""
        scale = 1.0 if c == 2 else (1 - self.shared) / (1 - self.freed[c]) if self.freed[c] < 1 else 0.0
        return F.greatest(n - F.lit(self.discount), F.lit(0.0)) * F.lit(scale / self.total[c])


def word_table(words: DataFrame, types: int) -> tuple[DataFrame, Level]:
    """(w, p0, p1, p, ratio): each word's probability in the classes and in the shared backoff, of contexts (w, n0, n1, n)."""
    level = Level.of(words, DISCOUNT)
    p = level.seen(F.col("n"), 2) + F.lit(level.freed[2] / (types + 1))
    own = [level.seen(F.col(f"n{c}"), c) + F.lit(level.shared) * F.col("p") for c in (0, 1)]
    return words.withColumn("p", p).withColumns({"p0": own[0], "p1": own[1]}).select("w", "p0", "p1", "p", F.log(F.col("p1") / F.col("p0")).alias("ratio")), level


def pair_table(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """(v, w, ratio, best): of pairs (v, w, n0, n1, n) that toxic texts hold; best is the larger ratio of their words."""
    level = Level.of(pairs, PAIR_DISCOUNT)
    first, last = words.select(F.col("w").alias("v"), F.col("p").alias("pv"), F.col("ratio").alias("rv")), words.select("w", "p0", "p1", F.col("ratio").alias("rw"))
    back = [level.seen(F.col("n"), 2) + F.lit(level.freed[2]) * F.col("pv") * F.col(f"p{c}") for c in (0, 1)]
    own = [level.seen(F.col(f"n{c}"), c) + F.lit(level.shared) * back[c] for c in (0, 1)]
    return pairs.join(first, "v").join(last, "w").select("v", "w", F.log(own[1] / own[0]).alias("ratio"), F.greatest("rv", "rw").alias("best"))


def expressions(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(w, p0, p1, p, ratio) of words and (v, w, ratio, best) of pairs that toxic rows hold, of rows (text, toxic 0 or 1); both stored."""
    spark = rows.sparkSession
    runs = rows.mapInArrow(_contexts(2), "w long, v long, classes byte").groupBy("w", "v").agg(F.bit_or("classes").alias("classes"))
    words = stored(_counted(runs, "w"), "words")
    table = stored(word_table(words, words.count())[0], "word-ratios")
    toxic = rows.where("toxic = 1").select("text").mapInArrow(_toxic_pairs, "key long")
    bitmap = spark.sparkContext.broadcast(_bitmap(toxic, PAIR_BITS))  # of 2 to the PAIR_BITS bits
    runs = rows.mapInArrow(_contexts(3, bitmap), "w long, v long, u long, classes byte").groupBy("w", "v", "u").agg(F.bit_or("classes").alias("classes"))
    pairs = stored(_counted(runs, "v", "w").where("n1 > 0"), "pairs")
    return table, stored(pair_table(pairs, table), "pair-ratios")


def first_table(pairs: DataFrame) -> DataFrame:
    """(v, k0, k1, k2, f0, f1, f2): of each word that toxic texts have before another, the contexts of its pairs, and the part of them that is freed, in the classes and in either."""
    sums = [F.sum(e).alias(f"{name}{c}") for c, n in enumerate(("n0", "n1", "n")) for name, e in (("k", F.col(n)), ("d", F.least(F.col(n), F.lit(PAIR_DISCOUNT))))]
    found = pairs.where(F.col("v") != BEGIN).groupBy("v").agg(*sums).where("k1 > 0")
    return found.select("v", "k0", "k1", "k2", *(F.when(F.col(f"k{c}") > 0, F.col(f"d{c}") / F.col(f"k{c}")).otherwise(1.0).alias(f"f{c}") for c in range(3)))


def given_table(pairs: DataFrame, firsts: DataFrame, words: DataFrame) -> DataFrame:
    """(v, w, p0, p1, ratio, best): of pairs (v, w, n0, n1, n) that toxic texts hold, the probability of w after v; best is the larger ratio of their words."""
    shared = F.greatest("f0", "f1")

    def seen(n: str, c: int, scale: Column) -> Column:
        return F.when(F.col(n) > PAIR_DISCOUNT, scale * (F.col(n) - PAIR_DISCOUNT) / F.col(f"k{c}")).otherwise(0.0)

    own = []
    for c in (0, 1):
        back = seen("n", 2, F.lit(1.0)) + F.col("f2") * F.col(f"q{c}")
        own.append(seen(f"n{c}", c, (1 - shared) / (1 - F.col(f"f{c}"))) + shared * back)
    first, last = words.select(F.col("w").alias("v"), F.col("ratio").alias("rv")), words.select("w", F.col("p0").alias("q0"), F.col("p1").alias("q1"), F.col("ratio").alias("rw"))
    joined = pairs.where(F.col("v") != BEGIN).join(firsts.join(first, "v"), "v").join(last, "w")
    return joined.select("v", "w", own[0].alias("p0"), own[1].alias("p1"), F.log(own[1] / own[0]).alias("ratio"), F.greatest("rv", "rw").alias("best"))


def given_expressions(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(w, p0, p1, p, ratio) of words and (v, w, p0, p1, ratio, best) of pairs that toxic rows hold, w given v, of rows (text, toxic 0 or 1); both stored.

    One shuffle counts all: pairs by the words before them, and from these the words and what begins with each.
    """
    runs = rows.mapInArrow(_contexts(3), "w long, v long, u long, classes byte")
    each = runs.repartition("w", "v").groupBy("w", "v", "u").agg(F.bit_or("classes").alias("classes"))  # stays dealt by pairs for the counts
    pairs = stored(_counted(each, "w", "v"), "pairs")
    classes = F.when(F.col("n0") > 0, 1).otherwise(0) + F.when(F.col("n1") > 0, 2).otherwise(0)
    words = stored(_counted(pairs.select("w", classes.alias("classes")), "w"), "words")
    table = stored(word_table(words, words.count())[0], "word-ratios")
    return table, stored(given_table(pairs.where("n1 > 0"), first_table(pairs), table), "pair-ratios")


def fit(rows: DataFrame, calibration: DataFrame, weigh=expressions) -> Model:
    """A model of rows (text, toxic 0 or 1), calibrated on the rows of calibration, whose number the caller bounds; weigh is `expressions` or `given_expressions`.

    All of rows are counted, and every word of them.  The driver gets at most BROADCAST_ROWS expressions.  Without calibration rows of both classes every score is the share of toxic ones among them, 0.001 at least and if there are none.
    """
    words, pairs = weigh(rows)
    own = words.where("ratio > 0").select(F.col("w").alias("key"), "ratio")
    found = stored(own.unionAll(pairs.where("ratio > 0 and ratio > best").mapInArrow(_keyed, "key long, ratio double")), "expressions")
    n = found.count()
    few = (found.orderBy(F.desc("ratio"), "key").limit(BROADCAST_ROWS) if n > BROADCAST_ROWS else found).toPandas().sort_values("key")
    model = Model(Table(uuid.uuid4().hex, few["key"].to_numpy(np.int64), few["ratio"].to_numpy(np.float64)))
    if n > BROADCAST_ROWS:
        # all that are not larger than the smallest in memory: some of its equals are in memory too, which changes nothing
        model.rest = stored(found.where(F.col("ratio") <= float(few["ratio"].min())), "rest")
        model.table.rest = _bitmap(model.rest, REST_BITS)

    def measure(batch: pa.RecordBatch, x: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x), pa.array(batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.float64))], ["x", "y"])

    seen = model.measured(calibration, "text", measure, "x double, y double").toPandas()
    model.intercept, model.slope = logistic(seen["x"].to_numpy(), seen["y"].to_numpy())
    return model


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = 100) -> tuple[float, float]:
    """(intercept, slope) of a logistic regression by Newton's method; ridge keeps them finite, and a slope is never negative."""
    if not len(y) or y.min() == y.max() or x.min() == x.max():
        share = min(max(y.mean() if len(y) else 0, 1e-3), 1 - 1e-3)
        return math.log(share / (1 - share)), 0.0
    centre, scale = x.mean(), x.std()
    z, w, keep = np.stack([np.ones(len(x)), (x - centre) / scale], axis=1), np.zeros(2), np.array([1e-9, ridge])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z.T * (p * (1 - p))) @ z + np.diag(keep), z.T @ (y - p) - keep * w)
        most = np.abs(step).max()
        w += step * min(1.0, 2 / max(most, 1e-300))
        if most < 1e-9:
            break
    slope = max(w[1], 0.0) / scale
    return float(w[0] - slope * centre), float(slope)


def fold(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_for_calibration: int = CALIBRATION_ROWS) -> Model:
    """Counts on all labelled rows of folds 2 to 4, calibration on at most rows_for_calibration labelled ids of fold 1; fold 0 is never read.

    Of several labels of one document the largest holds.
    """
    marked = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    rows = texts(docs, id_col, text_col)
    counted = _near(rows.where(fold() > 1), marked.where(fold() > 1), "doc_id")
    some = marked.where(fold() == 1).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows_for_calibration)  # ids and labels alone
    return fit(counted.select("text", "toxic"), _near(rows.where(fold() == 1), some, "doc_id").select("text", "toxic"), given_expressions)


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out (fold 0), score in 0..1, predicted (1 if score >= 0.5).

    The text alone is an input of the score.  A null or empty text has the score of no evidence.  A null doc_id is
    scored like any other and not held out.  Repeated rows are repeated; an empty table gives an empty result.
    """

    def made(batch: pa.RecordBatch, x: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score(x))], ["doc_id", "score"])

    score = model.scores()
    scored = model.measured(texts(docs, id_col, text_col), "text", made, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_ordinary(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text scores under 0.5, unchanged, also those that share an id or have none."""
    score = model.scores()
    return model.measured(docs, text_col, lambda batch, x: batch.filter(pa.array(score(x) < 0.5)), docs.schema)
