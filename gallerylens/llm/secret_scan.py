"""Secret scans in DataFrame operations, with multipart credential linking.

Assignments, access identifiers and long hexadecimal runs are found on their own.  Weak candidates - a key of
40 characters, a login, an endpoint - are found too, but are reported only where parts that complete them
occur within one scope: an interval join of the parts of a document, by the buckets that each part's interval,
widened by half a scope at either side, covers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .common import ROW, keyed, stored, texts

SCOPE, BLOCK = 300, 128
#: Fixed patterns, in the order that breaks ties of the start; (kind, pattern, group with a least length, that length).
BASE = [
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=\-]+)""", 2, 6),
    ("access", r"(AKIA[A-Z0-9]+)", 1, 20),
    ("hex", r"([0-9a-f]{24,})", 1, 24),
]
WEAK = [
    ("key", r"(?<![A-Za-z0-9/+=])([A-Za-z0-9/+]{40})(?![A-Za-z0-9/+=])", 1, 40),
    ("login", r"""([Uu][Ss][Ee][Rr]_?[Nn][Aa][Mm][Ee]|[Uu][Ss][Ee][Rr]|[Ll][Oo][Gg][Ii][Nn]|[Cc][Ll][Ii][Ee][Nn][Tt]_?[Ii][Dd])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@\-]+)""", 2, 3),
    # a scheme has 32 characters at most: without an end a run of letters would be read again from each of its places
    ("endpoint", r"""([A-Za-z][A-Za-z0-9+.\-]{0,31}://[^\x00-\x20"'<>]+)""", 1, 8),
]
#: What a text must hold for a match, where that is sooner told.
NEEDS = {"access": "AKIA", "endpoint": "://"}
KINDS = [k for k, *_ in BASE + WEAK]
IDENTIFIERS, SECRETS = ["access", "login"], ["assign", "hex", "key"]
SPAN = "struct<start:int,rank:int,end:int,kind:string>"


def _bound(value: Column, use) -> Column:
    """use(value) with value computed once, however often use refers to it."""
    return F.transform(F.array(value), use)[0]


def running(values: Column, zero: Column, both) -> Column:
    """For each element what both(a, b) makes of zero and all elements before it, by blocks: time grows as a power of 3/2 at most, with a factor under one in a hundred."""
    over = lambda a: F.aggregate(a, zero, both)
    size = F.size(values)
    blocks = F.when(size > 0, F.transform(F.sequence(F.lit(0), F.floor((size - 1) / BLOCK).cast("int")), lambda k: F.slice(values, k * BLOCK + 1, BLOCK)))

    def each(cut: Column) -> Column:
        first = _bound(F.transform(cut, over), lambda sums: F.transform(cut, lambda _, k: over(F.slice(sums, 1, k))))
        return F.flatten(F.zip_with(cut, first, lambda x, start: F.transform(x, lambda _, i: both(start, over(F.slice(x, 1, i))))))

    return F.when(size > 0, _bound(blocks, each)).otherwise(F.filter(values, lambda x: F.lit(False)))


def find_spans(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """The leftmost non-overlapping matches whose group has at least `least` characters, as (start, rank, end, kind).

    Positions are code points: a match starts after the gaps and matches before it.
    """
    match = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
    rank = KINDS.index(kind)
    # where the group is the whole match it is not sought a second time
    held = match(group) if group > 1 else None
    pairs = F.zip_with(F.split(text, pattern, -1), match(0), lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("m"), F.length(m).alias("h")))
    if held is not None:
        pairs = F.zip_with(pairs, held, lambda s, h: F.struct(s["g"].alias("g"), s["m"].alias("m"), F.length(h).alias("h")))
    sizes = F.filter(pairs, lambda s: s["m"].isNotNull())

    def placed(s: Column) -> Column:
        before = running(F.transform(s, lambda x: x["g"] + x["m"]), F.lit(0), lambda a, b: a + b)
        spans = F.zip_with(before, s, lambda at, x: F.when(x["h"] >= least, F.struct((at + x["g"]).alias("start"), F.lit(rank).alias("rank"), (at + x["g"] + x["m"]).alias("end"), F.lit(kind).alias("kind"))))
        return F.filter(spans, lambda p: p.isNotNull())

    none = F.array().cast(f"array<{SPAN}>")
    likely = F.regexp_like(text, F.lit(pattern))
    return F.when(F.contains(text, F.lit(NEEDS[kind])) & likely if kind in NEEDS else likely, _bound(sizes, placed)).otherwise(none)


def spans_digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def link_parts(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak parts of (uid, start, rank, end, kind) that are completed within scope characters.

    A key needs an identifier, a login needs a secret, an endpoint needs both.  The join yields each weak part
    at most once a condition, whatever the number of its partners.
    """
    low, high = F.floor((F.col("start") - scope / 2) / scope), F.floor((F.col("end") + scope / 2) / scope)
    placed = parts.withColumn("bucket", F.explode(F.sequence(low, high)))
    weak = placed.where(F.col("kind").isin(KINDS[len(BASE) :]))

    def near(left: DataFrame, kinds: list[str]) -> DataFrame:
        right = placed.where(F.col("kind").isin(kinds)).select("uid", "bucket", F.col("start").alias("s"), F.col("end").alias("e")).distinct()
        met = left.alias("l").join(right.alias("r"), (F.col("l.uid") == F.col("r.uid")) & (F.col("l.bucket") == F.col("r.bucket")) & (F.col("s") <= F.col("l.end") + scope) & (F.col("e") >= F.col("l.start") - scope), "left_semi")
        return met.select("uid", "start", "rank", "end", "kind").distinct()

    key, login, endpoint = (weak.where(F.col("kind") == k) for k in ("key", "login", "endpoint"))
    both = near(endpoint, IDENTIFIERS).join(near(endpoint, SECRETS), ["uid", "start", "rank", "end", "kind"], "left_semi")
    return near(key, IDENTIFIERS).unionAll(near(login, SECRETS)).unionAll(both)


def scan_parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """Stored: uid, doc_id, base and weak spans of each text, and carry."""
    df = texts(docs, id_col, text_col, carry)
    sorted_of = lambda rules: F.sort_array(F.concat(*(find_spans(F.col("text"), *r) for r in rules)))
    return stored(df.select(F.monotonically_increasing_id().alias("uid"), "doc_id", sorted_of(BASE).alias("base"), sorted_of(WEAK).alias("weak"), *carry), "parts")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE, carry: Sequence[str] = ()) -> DataFrame:
    """One row per document: doc_id, base and found (arrays of spans start, rank, end, kind by start, then kind), and carry, columns that may name the row.

    Ends are exclusive and positions are code points.  A null or empty text has no spans; repeated rows are
    repeated, each scanned for itself, also without an id; an empty table gives an empty result.
    """
    held = scan_parts(docs, id_col, text_col, carry)
    parts = held.where("size(weak) > 0").select("uid", F.explode(F.concat("base", "weak")).alias("x")).select("uid", "x.*")
    linked = link_parts(parts, scope).groupBy("uid").agg(F.collect_list(F.struct("start", "rank", "end", "kind")).alias("linked"))
    return held.join(linked, "uid", "left").select("doc_id", "base", F.sort_array(F.concat("base", F.coalesce("linked", F.array().cast(f"array<{SPAN}>")))).alias("found"), *carry)


def _cut(text: Column, spans: Column, mark: str) -> Column:
    """text with what the spans (by start) cover replaced by mark, overlapping spans by one."""
    step = 4096  # characters of a block, so that a piece is sought in few

    def whole(blocks: Column) -> Column:
        def piece(a: Column, b: Column) -> Column:
            own = lambda k: F.substring(F.get(blocks, k), F.greatest(a - k * step, F.lit(0)) + 1, F.least(b, (k + 1) * step) - F.greatest(a, k * step))
            return F.when(a < b, F.array_join(F.transform(F.sequence(F.floor(a / step).cast("int"), F.floor((b - 1) / step).cast("int")), own), "")).otherwise("")

        def pieces(reach: Column) -> Column:
            # reach: the largest end of the spans before each; a span that begins behind it leaves a piece of text
            kept = F.filter(F.zip_with(spans, reach, lambda s, r: F.when(s["start"] >= r, piece(r, s["start"]))), lambda x: x.isNotNull())
            return F.array_join(F.concat(kept, F.array(piece(F.array_max(F.transform(spans, lambda s: s["end"])), F.length(text)))), mark)

        return _bound(running(F.transform(spans, lambda s: s["end"]), F.lit(0), lambda a, b: F.greatest(a, b)), pieces)

    return _bound(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0)), whole)


def redact(docs: DataFrame, mark: str = "[secret]", broadcast_spans: int = 500_000, scope: int = SCOPE, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """docs with every span found in text_col replaced by mark, overlapping spans by one; chars_col follows where docs has it.

    Each row is scanned and cut for itself, also rows that share an id or have none.  Rows without spans are
    unchanged: a null text stays null.  Other columns may have any names.  An empty table gives an empty result.
    """
    whole = keyed(docs)
    found = scan_secrets(whole, id_col, text_col, scope, ROW).where("size(found) > 0")
    found = stored(found.select(*ROW, F.col("found").alias("__found")), "found")
    size = found.agg(F.count("*"), F.coalesce(F.sum(F.size("__found")), F.lit(0))).first()
    few = size[0] + size[1] <= broadcast_spans  # of 40 bytes each
    cut = _cut(F.col(f"`{text_col}`"), F.col("__found"), mark)
    joined = whole.join(F.broadcast(found) if few else found, ROW, "left")
    joined = joined.withColumn("__text", F.when(F.col("__found").isNull(), F.col(f"`{text_col}`")).otherwise(cut))
    out = {text_col: F.col("__text"), chars_col: F.when(F.col("__found").isNull(), F.col(f"`{chars_col}`")).otherwise(F.length("__text")) if chars_col in docs.columns else None}
    return joined.select(*(out[f.name].cast(f.dataType).alias(f.name) if f.name in out else F.col(f"`{f.name}`") for f in docs.schema))
