"""Pages to fragments, attached images, packing of a page, shards."""

from __future__ import annotations

from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import html as H, text as X
from .ranks import ranked

#: Needles that are shipped at once.
NEEDLES = 200_000
BLOCKED = ("BULLET::::", "Section::::", "<templatestyles")


def paragraphs(lines: DataFrame, key: str = "doc_id", least: int = 100) -> DataFrame:
    """(key, paragraph_id, line): lines (key, pos, line) squeezed, of at least so many characters, numbered from 0 in each page."""
    squeezed = lines.withColumn("line", X.squeeze(F.col("line")))
    blocked = F.col("line").startswith(BLOCKED[0])
    for b in BLOCKED[1:]:
        blocked = blocked | F.col("line").startswith(b)
    kept = squeezed.where((F.length("line") >= least) & ~blocked)
    return kept.withColumn("paragraph_id", (F.row_number().over(Window.partitionBy(key).orderBy("pos")) - 1).cast("long")).select(key, "paragraph_id", "line")


def sections(pages: DataFrame) -> DataFrame:
    """(page_id, section, line_no, line): texts split at anchors of files, then into lines."""
    cut = pages.select("page_id", F.posexplode(F.split("text", r'<a href="(?:File|InfoboxHeader)[^"]*">.*?</a>')).alias("section", "part"))
    return cut.select("page_id", "section", F.posexplode(F.split("part", "\n")).alias("line_no", "line")).where(F.trim("line") != "")


def page_fragments(pages: DataFrame, images: DataFrame, key: str = "page_id", least: int = 100) -> DataFrame:
    """Pages (key, title, url, text) to fragments (id, key, paragraph_id, title, url, wiki_id, text, images).

    A text is cut into sections at anchors of files, and into lines; blank and blocked lines go, the first line
    left is the page's heading and no fragment, and the first infobox of the line after it is taken out.  Lines of
    at least so many characters, white space squeezed, are fragments, numbered from 0 in their page and, as id,
    over all pages in order of key.

    images has the column file: names of the pictures at hand.  A page's pictures, (caption, type, url, file), are
    its anchors of files and infoboxes whose file is at hand.  The first, if an infobox, belongs to the first
    section, and each other one to the section after those before it; it goes to the first fragment of that
    section or, if it has none, of the next section that has and still has a picture of its own.  Others are
    dropped.  A page without a line, or null, has no fragments.
    """
    anchor = r'<a href="File[^"]+">(?:.*?)</a>'
    infobox = r'<a href="InfoboxHeader[^"]+">(?:.*?)</a>'
    found = pages.select(key, F.posexplode(H.links(F.col("text"))).alias("pos", "x")).select(key, "pos", F.trim("x.caption").alias("caption"), H.link_kind(F.col("x.url")).alias("type"), F.col("x.url").alias("url"))
    found = found.where("type is not null").withColumn("file", H.link_file(F.col("url"))).join(images.select("file").distinct(), "file", "left_semi")
    listed = found.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "caption", "type", "url", "file"))).alias("xs"))
    picture = "struct<caption:string,type:string,url:string,file:string>"
    own = F.transform(F.coalesce("xs", F.array().cast("array<struct<pos:int,caption:string,type:string,url:string,file:string>>")), lambda x: F.struct(x["caption"].alias("caption"), x["type"].alias("type"), x["url"].alias("url"), x["file"].alias("file")))
    # without an infobox in front, the first section has no picture
    placed = F.when((F.size("own") > 0) & (F.get("own", F.lit(0))["type"] != "infobox"), F.concat(F.array(F.lit(None).cast(picture)), "own")).otherwise(F.col("own"))

    bad = lambda x: reduce(lambda a, b: a | b, [x.startswith(p) for p in BLOCKED])
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    lines = F.transform(F.split("text", anchor), lambda part: F.filter(F.transform(F.split(part, "\n"), strip), lambda x: (x != "") & ~bad(x)))
    box = F.regexp_extract(F.get("head", F.lit(1)), infobox, 0)
    line = F.when(box == "", F.get("head", F.lit(1))).otherwise(strip(F.replace(F.get("head", F.lit(1)), box, F.lit(""))))
    first = F.concat(F.filter(F.array(line), lambda x: x != ""), F.slice("head", 3, F.greatest(F.size("head") - 2, F.lit(0))))
    long = lambda part: F.filter(F.transform(part, lambda x: F.regexp_replace(x, r"\s+", " ")), lambda x: F.length(x) >= least)

    df = pages.join(listed, key, "left").withColumn("own", own).withColumn("placed", placed).withColumn("lines", lines).withColumn("head", F.get("lines", F.lit(0))).where("size(head) > 0")
    df = df.withColumn("first", first).withColumn("parts", F.transform(F.concat(F.array("first"), F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(1)))), long))
    full = F.filter(F.transform("parts", lambda p, j: F.when((F.size(p) > 0) & (j < F.size("placed")), j)), lambda j: j.isNotNull())
    df = df.withColumn("full", full)
    before = lambda j: F.coalesce(F.array_max(F.filter("full", lambda f: f < j)), F.lit(-1))
    given = lambda j: F.when(F.array_contains("full", j), F.filter(F.slice("placed", before(j) + 2, j - before(j)), lambda x: x.isNotNull())).otherwise(F.array().cast(f"array<{picture}>"))
    sectioned = F.flatten(F.transform("parts", lambda p, j: F.transform(p, lambda x, k: F.struct(x.alias("text"), F.when(k == 0, given(j)).otherwise(F.array().cast(f"array<{picture}>")).alias("images")))))
    out = df.select(key, "title", "url", H.curid(F.col("url")).alias("wiki_id"), F.posexplode(sectioned).alias("paragraph_id", "f")).select(key, F.col("paragraph_id").cast("long").alias("paragraph_id"), "title", "url", "wiki_id", "f.text", "f.images")
    return ranked(out, [key, "paragraph_id"], name="id")


def containing(rows: DataFrame, text: str, needle: str) -> DataFrame:
    """The rows whose text contains needle; all rows if none does."""
    marked = rows.withColumn("_found", F.coalesce(F.col(text).contains(needle), F.lit(False)))
    some = marked.agg(F.coalesce(F.bool_or("_found"), F.lit(False)).alias("_any"))  # one row
    return marked.crossJoin(F.broadcast(some)).where("_found or not _any").drop("_found", "_any")


def first_containing(documents: DataFrame, needles: DataFrame, most: int = NEEDLES) -> DataFrame:
    """(item_id, doc_id): for each needle (item_id, q) the smallest doc_id of documents (doc_id, text) that contain it, null if none does.

    Needles, a bounded set, are shipped `most` at a time as one automaton, by which a task reads each text once
    for all of them; it passes on one document a needle.  An empty needle is in every text, a null one in none.
    """
    spark, out, block = documents.sparkSession, None, []

    def scan(block: list[tuple[int, str]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(block)

        def run(batches):
            import ahocorasick

            by_needle: dict[str, list[int]] = {}
            for item, q in shared.value:
                by_needle.setdefault(q, []).append(item)
            machine = ahocorasick.Automaton()
            for q in by_needle:
                if q:
                    machine.add_word(q, q)
            if len(machine):
                machine.make_automaton()
            first: dict[str, int] = {}
            for batch in batches:
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    if doc is None or text is None:
                        continue
                    for q in {q for _, q in machine.iter(text)} | ({""} & by_needle.keys()) if len(machine) else {""} & by_needle.keys():
                        first[q] = min(first.get(q, doc), doc)
            rows = [(item, doc) for q, doc in first.items() for item in by_needle[q]]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["item_id", "doc_id"])

        return documents.select("doc_id", "text").mapInArrow(run, "item_id long, doc_id long")

    for row in needles.select(F.col("item_id").cast("long"), "q").where("q is not null").toLocalIterator():
        block.append(tuple(row))
        if len(block) >= most:
            out, block = scan(block) if out is None else out.unionAll(scan(block)), []
    if block or out is None:
        out = scan(block) if out is None else out.unionAll(scan(block))
    return needles.select("item_id").join(out.groupBy("item_id").agg(F.min("doc_id").alias("doc_id")), "item_id", "left")


def title(text: Column) -> Column:
    """The first line that is not blank."""
    return F.get(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""), F.lit(0))


def attach_forward(points: DataFrame, partition: str, order: list[str], is_target: Column, value: str, is_source: Column) -> DataFrame:
    """Sources with the value of the next target after them in their partition; sources without one are dropped."""
    w = Window.partitionBy(partition).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    found = points.withColumn("attached", F.first(F.when(is_target, F.col(value)), ignorenulls=True).over(w))
    return found.where(is_source & F.col("attached").isNotNull())


def grid(rows: DataFrame, group: str, order: list[str], size: str, per_row: int = 2) -> DataFrame:
    """(group, row, height, y): items packed per_row in a row, whose height is its largest item; y is what stands above."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1
    placed = rows.withColumn("row", F.floor(n / per_row).cast("long"))
    heights = placed.groupBy(group, "row").agg(F.max(size).alias("height"), F.count("*").alias("items"))
    above = F.sum("height").over(Window.partitionBy(group).orderBy("row").rowsBetween(Window.unboundedPreceding, -1))
    return heights.withColumn("y", F.coalesce(above, F.lit(0.0)))


def within_budget(packed: DataFrame, budget: float) -> DataFrame:
    """The rows up to the first that overflows; heights are not negative, so that is a prefix."""
    return packed.where(F.col("y") + F.col("height") <= budget)


def shards(rows: DataFrame, order: str, n: int) -> DataFrame:
    """(shard, size, start) of n contiguous shards whose sizes differ by one at most."""
    total, place = rows.count(), F.col("_place")
    big, small = total % n, total // n
    edge = big * (small + 1)
    shard = F.when(place < edge, F.floor(place / F.lit(small + 1))).otherwise(big + F.floor((place - edge) / F.lit(max(small, 1))))
    sizes = ranked(rows, [order], name="_place").withColumn("shard", shard.cast("long")).groupBy("shard").agg(F.count("*").alias("size"))
    return sizes.withColumn("start", F.coalesce(F.sum("size").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def wrap(c: Column, width: int) -> Column:
    """The text in lines of at most width characters, filled greedily; a longer word is a line of its own."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        def lines(text: str | None) -> list[str]:
            out: list[str] = []
            for word in (text or "").split():
                if out and len(out[-1]) + 1 + len(word) <= width:
                    out[-1] += " " + word
                else:
                    out.append(word)
            return out

        return s.map(lines)

    return run(c)


def wrap_pixels(c: Column, width: float, glyphs: dict[str, float], other: float) -> Column:
    """The text in lines of at most width, filled greedily word by word; glyphs has the widths of a font's characters, other that of all that it lacks.

    A line's width counts the space after its last word, as page rendering does.  Words are what single spaces part, so
    that two spaces leave an empty word, and a word wider than a line stands alone, behind an empty line if it is the
    first.  A null text is one empty line.
    """

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        space = glyphs.get(" ", other)

        def lines(text: str | None) -> list[str]:
            out, held, filled = [], [], 0.0
            for word in (text or "").split(" "):
                own = sum(glyphs.get(x, other) for x in word) + space
                if filled + own > width:
                    out.append(" ".join(held))
                    held, filled = [], 0.0
                held.append(word)
                filled += own
            return [*out, " ".join(held)]

        return s.map(lines)

    return run(c)


def resize(width: Column, height: Column, target: float, least: int = 28) -> tuple[Column, Column]:
    """Whole width and height of about target pixels in the same ratio, each at least so long."""
    ratio = width / height
    h = F.sqrt(F.lit(target) / ratio)
    return F.greatest(F.floor(F.lit(target) / h), F.lit(least)), F.greatest(F.floor(h), F.lit(least))
