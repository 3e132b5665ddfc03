"""Queries on documents, pages and micro-fixtures: fragments, links, URLs and text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import html as H, text as X
from ..operators import fragments, merge, sentences
from ..operators.ranks import ranked
from .registry import Registry
from .views import Tables

R = Registry()
query = R.query

_SQUEEZE = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
_PARAS = f"WITH k AS (SELECT doc_id, pos, {_SQUEEZE.format('line')} AS line FROM paras), f AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS paragraph_id, line FROM k WHERE length(line) >= 100 AND NOT (starts_with(line, 'BULLET::::') OR starts_with(line, 'Section::::') OR starts_with(line, '<templatestyles')))"


@query(f"{_PARAS} SELECT doc_id, paragraph_id, line FROM f", "paras")
def frag_paragraphs(t: Tables) -> DataFrame:
    return fragments.paragraphs(t.paras())


@query(f"{_PARAS} SELECT doc_id, paragraph_id FROM f WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)", "paras")
def frag_semi_filter(t: Tables) -> DataFrame:
    good = t.labels.where("quality = 1").select("doc_id")
    return fragments.paragraphs(t.paras()).join(good, "doc_id", "left_semi").select("doc_id", "paragraph_id")


@query("SELECT doc_id, (pos + 1) // 2 AS section, (pos + 1) % 2 AS line_no, line FROM paras WHERE trim(line) <> ''", "paras")
def frag_sections(t: Tables) -> DataFrame:
    """Every other line of a document begins with a file's anchor."""
    doc, pos = F.col("doc_id"), F.col("pos")
    line = F.concat(F.when(pos % 2 == 1, F.concat(F.lit('<a href="File%3A'), doc, F.lit('.jpg">cap</a>'))).otherwise(""), "line")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"]), "\n")
    cut = fragments.sections(t.paras().groupBy(doc.alias("page_id")).agg(text.alias("text")))
    return cut.select(F.col("page_id").alias("doc_id"), F.col("section").cast("long").alias("section"), F.when(F.col("section") == 0, F.col("line_no") + 1).otherwise(F.col("line_no")).cast("long").alias("line_no"), "line")


_PARTED = "text || ' (it cannot, \"won''t\": ' || item_id || '; they''re gonna--ok? I''ll go...) We''d 1,000.'"


def _parted() -> str:
    sql = _PARTED
    for pattern, put in X.TREEBANK:
        sql = f"regexp_replace({sql}, '" + pattern.replace("'", "''") + "', '" + put.replace("'", "''").replace("$1", "\\1").replace("$2", "\\2").replace("$3", "\\3") + "', 'g')"
    return sql


@query(f"SELECT item_id, array_to_string(list_filter(string_split_regex({_parted()}, '\\s+'), lambda w: w <> ''), '|') AS tokens FROM benchmark")
def txt_treebank(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", F.array_join(X.treebank(F.expr(_PARTED.replace("''", "\\'"))), "|").alias("tokens"))


#: Pages made of documents: an infobox in some, a file's anchor before every other line in some, and which pictures are at hand.
_BOX = "'<a href=\"InfoboxHeader%3Abox%20' || doc_id || '.png\">info</a> ' || CASE WHEN doc_id % 8 = 1 THEN repeat('words about this page ', 6) ELSE '' END"
_PAGES_SQL = (
    "WITH kept AS (SELECT doc_id, CASE WHEN doc_id % 4 >= 2 THEN pos // 2 + 1 ELSE 0 END AS section, pos, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS text FROM paras UNION ALL SELECT doc_id, 0, -1, trim(repeat('words about this page ', 6)) FROM documents WHERE doc_id % 8 = 1), "
    "frags AS (SELECT doc_id, section, pos, text, row_number() OVER (PARTITION BY doc_id ORDER BY section, pos) - 1 AS paragraph_id, row_number() OVER (ORDER BY doc_id, section, pos) - 1 AS id, row_number() OVER (PARTITION BY doc_id, section ORDER BY pos) AS place FROM kept WHERE length(text) >= 100 AND NOT (starts_with(text, 'BULLET::::') OR starts_with(text, 'Section::::') OR starts_with(text, '<templatestyles'))), "
    "pics AS (SELECT doc_id, -1 AS pos, 'infobox' AS type, 'box_' || doc_id || '.png' AS file FROM documents WHERE doc_id % 2 = 1 AND doc_id % 8 <> 5 UNION ALL SELECT doc_id, pos, 'thumb', 'pic_' || doc_id || '_' || pos || '.jpg' FROM paras WHERE doc_id % 4 >= 2 AND pos % 2 = 0 AND (doc_id + pos) % 3 <> 1), "
    "placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - (min(pos) OVER (PARTITION BY doc_id) = -1)::INT AS k, count(*) OVER (PARTITION BY doc_id) + (min(pos) OVER (PARTITION BY doc_id) <> -1)::INT AS n FROM pics), "
    "goes AS (SELECT p.doc_id, p.k, p.type || ':' || p.file AS pic, min(f.section) AS section FROM placed p JOIN frags f ON f.doc_id = p.doc_id AND f.section >= p.k AND f.section < p.n GROUP BY ALL) "
    "SELECT id, f.doc_id, paragraph_id, f.doc_id::INT AS wiki_id, text, coalesce(string_agg(pic, ',' ORDER BY k), '') AS images FROM frags f LEFT JOIN goes g ON g.doc_id = f.doc_id AND g.section = f.section AND f.place = 1 GROUP BY id, f.doc_id, paragraph_id, text"
)


def _wiki(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Pages with their heading, infobox and anchors as text, and the pictures at hand."""
    doc, pos = F.col("doc_id"), F.col("pos")
    lines = t.paras()
    anchor = F.concat(F.lit('<a href="File%3Apic%20'), doc, F.lit("_"), pos, F.lit('.jpg"> shows '), pos, F.lit(" </a>\n"))
    marked = lines.select("doc_id", "pos", F.concat(F.when((doc % 4 >= 2) & (pos % 2 == 0), anchor).otherwise(""), "line").alias("line"))
    body = marked.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("body"))
    box = F.when(doc % 2 == 1, F.concat(F.expr(_BOX), F.lit("\n"))).otherwise("")
    pages = body.select("doc_id", F.concat(F.lit("page "), doc).alias("title"), F.concat(F.lit("https://e.example.org/?curid="), doc).alias("url"), F.concat(F.lit("Page "), doc, F.lit(" \n\n"), box, "body").alias("text"))
    boxes = t.documents.where("doc_id % 8 != 5").select(F.concat(F.lit("box_"), doc, F.lit(".png")).alias("file"))
    files = lines.where("(doc_id + pos) % 3 != 1").select(F.concat(F.lit("pic_"), doc, F.lit("_"), pos, F.lit(".jpg")))
    return pages, boxes.unionAll(files)


@query(_PAGES_SQL, "paras")
def page_fragments(t: Tables) -> DataFrame:
    found = fragments.page_fragments(*_wiki(t), "doc_id")
    named = F.array_join(F.transform("images", lambda x: F.concat(x["type"], F.lit(":"), x["file"])), ",")
    return found.select("id", "doc_id", "paragraph_id", "wiki_id", "text", named.alias("images"))


@query("SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[1] AS title FROM documents")
def frag_title(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", fragments.title(F.col("text")).alias("title"))


_ANCHOR = """regexp_extract_all(html, '<a href="([^"]+)">(.*?)</a>', {})"""
_LINKS = f"SELECT page_id, unnest(range(len(u))) AS pos, unnest(u) AS url, unnest(c) AS caption FROM (SELECT page_id, {_ANCHOR.format(1)} AS u, {_ANCHOR.format(2)} AS c FROM pages)"


@query(_LINKS)
def html_links(t: Tables) -> DataFrame:
    found = t.pages.select("page_id", F.posexplode(H.links(F.col("html"))).alias("pos", "x"))
    return found.select("page_id", F.col("pos").cast("long").alias("pos"), "x.url", "x.caption")


@query(f"SELECT page_id, n FROM (SELECT page_id, CAST(len({_ANCHOR.format(1)}) AS BIGINT) AS n FROM pages) WHERE n >= 3")
def frag_min_links(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.size(H.links(F.col("html"))).cast("long").alias("n")).where("n >= 3")


@query(f"SELECT n, count(*) AS pages FROM (SELECT CAST(len({_ANCHOR.format(1)}) AS BIGINT) AS n FROM pages) GROUP BY n")
def frag_link_histogram(t: Tables) -> DataFrame:
    return t.pages.select(F.size(H.links(F.col("html"))).cast("long").alias("n")).groupBy("n").agg(F.count("*").alias("pages"))


_PREFIXED = "CASE pos % 3 WHEN 0 THEN 'File%3A' WHEN 1 THEN 'InfoboxHeader%3A' ELSE '' END || replace(url, '/', '%20')"


@query(f"SELECT page_id, pos, CASE pos % 3 WHEN 0 THEN 'thumb' WHEN 1 THEN 'infobox' END AS kind, CASE WHEN pos % 3 < 2 THEN replace(url, '/', '_') END AS file FROM ({_LINKS}) WHERE NOT contains(url, '%20')")
def html_link_classify(t: Tables) -> DataFrame:
    named = html_links(t).where("not contains(url, '%20')").select("page_id", "pos", F.expr(_PREFIXED).alias("url"))
    return named.select("page_id", "pos", H.link_kind(F.col("url")).alias("kind"), H.link_file(F.col("url")).alias("file"))


_UNESCAPE = "replace(replace(replace(replace(replace(replace(replace({}, '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '&lt;', '<'), '&gt;', '>'), '&nbsp;', ' '), '&amp;', '&')"
_HTML_PARAS = "SELECT page_id, unnest(range(len(ps))) AS pos, trim(regexp_replace(" + _UNESCAPE.format("regexp_replace(unnest(ps), '<[^>]*>', '', 'g')") + ", '\\s+', ' ', 'g')) AS text FROM (SELECT page_id, regexp_extract_all(regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g'), '(?s)<p[^>]*>(.*?)</p>', 1) AS ps FROM pages)"


def _html_paras(t: Tables) -> DataFrame:
    found = t.pages.select("page_id", F.posexplode(H.paragraphs(F.col("html"))).alias("pos", "text"))
    return found.withColumn("pos", F.col("pos").cast("long"))


@query(_HTML_PARAS)
def html_paragraphs(t: Tables) -> DataFrame:
    return _html_paras(t)


@query(f"SELECT page_id, pos, CAST(len(w) AS BIGINT) AS n_tokens, array_to_string(w[1:1024], ' ') AS head FROM (SELECT page_id, pos, string_split(text, ' ') AS w FROM ({_HTML_PARAS})) WHERE len(w) >= 10")
def doc_token_gate(t: Tables) -> DataFrame:
    w = _html_paras(t).select("page_id", "pos", F.split("text", " ").alias("w")).where("size(w) >= 10")
    return w.select("page_id", "pos", F.size("w").cast("long").alias("n_tokens"), F.array_join(F.slice("w", 1, 1024), " ").alias("head"))


@query(f"SELECT page_id, string_agg(text, ' ' ORDER BY pos) AS text FROM ({_HTML_PARAS}) WHERE text <> '' GROUP BY page_id")
def doc_concat_paragraphs(t: Tables) -> DataFrame:
    listed = _html_paras(t).where("text != ''").groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("xs"))
    return listed.select("page_id", X.squeeze(F.array_join(F.transform("xs", lambda s: s["text"]), " ")).alias("text"))


@query("SELECT page_id, string_split(url, '/')[-1] AS segment FROM pages")
def url_last_segment(t: Tables) -> DataFrame:
    return t.pages.select("page_id", H.last_segment(F.col("url")).alias("segment"))


_IMAGE = "url || '/a!b/pic.' || page_id || CASE page_id % 3 WHEN 0 THEN '.JPG!Large.jpg' WHEN 1 THEN '.png' ELSE '.JPG!HalfHD.jpg!HD.x' END"


@query("SELECT page_id, name, unnest(range(7)) AS pos, u || '!' || unnest(['HD', 'HalfHD', 'Large', 'Blog', 'Portrait', 'PinterestLarge', 'PinterestSmall']) || CASE page_id % 3 WHEN 1 THEN '.png' ELSE '.JPG' END AS url FROM (SELECT page_id, 'pic.jpg' AS name, url || '/a!b/pic.' || page_id || CASE page_id % 3 WHEN 1 THEN '.png' ELSE '.JPG' END AS u FROM pages)")
def url_candidates(t: Tables) -> DataFrame:
    rows = t.pages.select("page_id", F.expr(_IMAGE).alias("u"))
    return rows.select("page_id", H.jpg_name(F.col("u")).alias("name"), F.posexplode(H.candidates(F.col("u"))).alias("pos", "url")).withColumn("pos", F.col("pos").cast("long"))


@query("SELECT page_id, CASE WHEN page_id % 3 < 2 THEN page_id::INT END AS curid FROM pages")
def url_curid(t: Tables) -> DataFrame:
    end = F.expr("CASE page_id % 3 WHEN 0 THEN '?curid=12&curid=' || page_id WHEN 1 THEN '?curid=' || page_id ELSE '?curid=' || page_id || 'x' END")
    return t.pages.select("page_id", H.curid(F.concat("url", end)).alias("curid"))


#: Entities, Vietnamese letters, ligatures and full-width letters are put in; the SQL has what they stand for.
_SPELLED = "replace(replace(replace(text, ' a', ' {}'), ' o', ' {}'), ' t', ' {}')"


@query(f"SELECT doc_id, regexp_replace(lower(replace(strip_accents({_SPELLED.format('&a', 'o', 'fit')}), 'ß', 'ss')), '[^a-z0-9_]+', '', 'g') AS title_key FROM documents")
def txt_clear_title(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.clear_title(F.expr(_SPELLED.format("&amp;&#225;", "ộ", "ﬁｔ"))).alias("title_key"))


@query("SELECT s_suppkey, replace(lower(strip_accents(s_name)), ' ', '-') || '-nguyen-zhostov' AS artist_key FROM supplier")
def txt_clear_artist(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", X.clear_artist(F.concat("s_name", F.lit(" Nguyễn Жостов"))).alias("artist_key"))


@query(f"SELECT doc_id, {_SQUEEZE.format('text')} AS text FROM documents")
def txt_squeeze(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.squeeze(F.col("text")).alias("text"))


@query(f"SELECT doc_id, regexp_replace(strip_accents({_SPELLED.format('a', 'o', 'fit')}), '[^\\x00-\\x7F]+', '', 'g') AS text FROM documents")
def txt_strip_accents(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.strip_accents(F.expr(_SPELLED.format("á", "ộ", "ﬁｔ"))).alias("text"))


_STYLE = "CASE p_partkey % 5 WHEN 0 THEN 'realism (' || p_brand || ')' WHEN 1 THEN 'SYMBOLISM (a) b (c)' ELSE p_name || ' (' || p_type || ') ' END"


@query(f"SELECT p_partkey, CASE WHEN q IN ('Realism', 'Symbolism') THEN q || ' (arts)' ELSE q END AS query FROM (SELECT p_partkey, trim(array_to_string(list_transform(string_split(regexp_replace(raw, '\\(.*\\)', ''), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')) AS q FROM (SELECT p_partkey, {_STYLE} AS raw FROM part))")
def txt_style_query(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", X.style_query(F.expr(_STYLE)).alias("query"))


@query("SELECT p_partkey, 'a painting by ' || array_to_string(list_transform(string_split(replace(lower(p_name), '-', ' '), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS prompt FROM part")
def txt_prompt(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.concat(F.lit("a painting by "), X.display_name(F.col("p_name"))).alias("prompt"))


@query("SELECT p_partkey, concat_ws(' ', p_name, p_brand, p_type) AS caption FROM part")
def txt_caption_join(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("caption"))


@query("SELECT conv_id, turn, CASE WHEN len(w) <= 30 THEN text WHEN ends_with(text, '.') AND NOT ends_with(c, '.') THEN c || '.' ELSE c END AS text FROM (SELECT conv_id, turn, text, w, array_to_string(w[1:30], ' ') AS c FROM (SELECT conv_id, turn, text, string_split(text, ' ') AS w FROM conversations))")
def txt_truncate(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", X.truncate_words(F.col("text"), 30).alias("text"))


@query("SELECT item_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(strip_accents(lower(text)), '[^\\x00-\\x7F]+', '', 'g'), '\\.\\.+', '', 'g'), '\\.(\\S)', '. \\1', 'g'), '\\s+', ' ', 'g')) AS text FROM benchmark")
def txt_ref_cleanup(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", X.reference_cleanup(F.col("text")).alias("text"))


@query("SELECT item_id, CAST(len(s) AS BIGINT) AS n, s[1] AS first FROM (SELECT item_id, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS s FROM benchmark)")
def txt_sentences(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", X.sentences(F.col("text")).alias("s")).select("item_id", F.size("s").cast("long").alias("n"), F.col("s")[0].alias("first"))


_ABBREVIATIONS = r"""
WITH w AS (SELECT regexp_replace(unnest(regexp_split_to_array(lower(coalesce(text, '')), '\s+')), '^["''(\[{«“‘„]+|["'')\]}»”’,;:!?]+$', '', 'g') AS w FROM documents),
c AS (SELECT CASE WHEN ends_with(w, '.') THEN w[:-2] ELSE w END AS word, sum(ends_with(w, '.')::INT) AS a, sum((NOT ends_with(w, '.'))::INT) AS b FROM w WHERE regexp_matches(w, '\p{L}') GROUP BY ALL),
p AS (SELECT sum(a) / sum(a + b) AS p FROM c),
s AS (SELECT word, a, b, length(replace(word, '.', '')) AS n, -2 * (a * ln(greatest(p, 1e-300)) + b * ln(greatest(1 - p, 1e-300)) - a * ln(0.99) - b * ln(0.01)) AS ratio FROM c, p WHERE a > 0 AND word <> '')
SELECT word, round(ratio * exp(-n) * (length(word) - n + 1) * pow(n, -b), 6) AS score FROM s WHERE ratio * exp(-n) * (length(word) - n + 1) * pow(n, -b) >= 0.3
"""


@query(_ABBREVIATIONS)
def txt_abbreviations(t: Tables) -> DataFrame:
    return sentences.abbreviations(t.documents).withColumn("score", F.round("score", 6))


def txt_sentences_learnt(t: Tables) -> DataFrame:
    """How many sentences each document has by the abbreviations of all, and how long the longest is."""
    found = sentences.sentences(t.documents, sentences.abbreviations(t.documents))
    return found.select("doc_id", F.size("sentences").alias("n"), F.coalesce(F.array_max(F.transform("sentences", lambda x: F.length(x))), F.lit(0)).alias("longest"))


query()(txt_sentences_learnt)


_THOUGHT = "CASE turn % 3 WHEN 0 THEN text WHEN 1 THEN '<think>' || role || '</think>' || text ELSE '<think>a</think>b</think>' || text END"


@query(f"SELECT conv_id, turn, string_split(raw, '</think>')[-1] AS answer FROM (SELECT conv_id, turn, {_THOUGHT} AS raw FROM conversations)")
def txt_after_think(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", X.after_last(F.expr(_THOUGHT), "</think>").alias("answer"))


_VERDICT = "text || CASE turn % 4 WHEN 0 THEN ' assistant: Yes, it does' WHEN 1 THEN ' assistant: yes assistant: no' WHEN 2 THEN ' assistant:' || chr(10) || '  YES' ELSE '' END"


@query(f"SELECT conv_id, turn, regexp_matches(string_split(raw, 'assistant:')[-1], '(?i)^\\s*yes') AS verdict FROM (SELECT conv_id, turn, {_VERDICT} AS raw FROM conversations)")
def verdict_parse(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", X.verdict(F.expr(_VERDICT), "assistant:").alias("verdict"))


@query("SELECT p_partkey, p_name FROM part WHERE NOT (contains(p_name, 'part 1') OR contains(p_name, 'ee'))")
def title_blacklist(t: Tables) -> DataFrame:
    return t.part.where(~X.contains_any(F.col("p_name"), ["part 1", "ee"])).select("p_partkey", "p_name")


@query("SELECT n.needle, doc_id FROM (VALUES ('license'), ('zzz no such text')) n(needle) JOIN documents d ON contains(d.text, n.needle) OR NOT EXISTS (SELECT 1 FROM documents e WHERE contains(e.text, n.needle))")
def contains_or_all(t: Tables) -> DataFrame:
    """One search with hits, and one without any."""
    found = [fragments.containing(t.documents.select("doc_id", "text"), "text", n).select(F.lit(n).alias("needle"), "doc_id") for n in ("license", "zzz no such text")]
    return found[0].unionAll(found[1])


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM documents")
def row_index(t: Tables) -> DataFrame:
    return ranked(t.documents.select("doc_id"), ["doc_id"], name="idx")


@query("SELECT min(doc_id) AS first_id FROM documents WHERE n_chars > 10000")
def first_match(t: Tables) -> DataFrame:
    return t.documents.where("n_chars > 10000").agg(F.min("doc_id").alias("first_id"))


@query("WITH b AS (SELECT item_id, array_to_string(string_split(text, ' ')[1:3], ' ') AS q FROM benchmark) SELECT item_id, min(doc_id) AS doc_id FROM b LEFT JOIN documents d ON contains(d.text, q) GROUP BY item_id")
def doc_lookup_top1(t: Tables) -> DataFrame:
    asked = t.benchmark.select("item_id", F.array_join(F.slice(F.split("text", " "), 1, 3), " ").alias("q"))
    return fragments.first_containing(t.documents, asked)


@query("SELECT event_id, user_id, attached FROM (SELECT event_id, user_id, event_type, first_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS attached FROM events) WHERE event_type = 'signup' AND attached IS NOT NULL")
def asof_forward_attach(t: Tables) -> DataFrame:
    e = t.events.select("event_id", "user_id", "event_type", "ts")
    kind = F.col("event_type")
    return fragments.attach_forward(e, "user_id", ["ts", "event_id"], kind == "view", "event_id", kind == "signup").select("event_id", "user_id", "attached")


_LINE_KEY = "md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_quantity AS BIGINT), CAST(round(l_extendedprice * 100) AS BIGINT)))"
_GRID = f"WITH o AS (SELECT l_partkey, l_quantity, (row_number() OVER (PARTITION BY l_partkey ORDER BY {_LINE_KEY}, l_quantity) - 1) // 2 AS row FROM lineitem), h AS (SELECT l_partkey, row, max(l_quantity) AS height, count(*) AS items FROM o GROUP BY ALL), y AS (SELECT *, coalesce(sum(height) OVER (PARTITION BY l_partkey ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS y FROM h)"


def _grid(t: Tables) -> DataFrame:
    key = F.md5(F.concat_ws("|", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_quantity").cast("long"), F.round(F.col("l_extendedprice") * 100).cast("long")))
    return fragments.grid(t.lineitem.withColumn("key", key), "l_partkey", ["key", "l_quantity"], "l_quantity")


@query(f"{_GRID} SELECT l_partkey, row, height, items FROM y WHERE y + height <= 300")
def pack_prefix_budget(t: Tables) -> DataFrame:
    return fragments.within_budget(_grid(t), 300).drop("y")


@query(f"{_GRID} SELECT l_partkey, row, height, items, y FROM y")
def pack_layout_offsets(t: Tables) -> DataFrame:
    return _grid(t)


@query("SELECT p_partkey, greatest(CAST(floor(10000 / h) AS BIGINT), 28) AS width, greatest(CAST(floor(h) AS BIGINT), 28) AS height FROM (SELECT p_partkey, sqrt(10000 / (p_size / p_retailprice)) AS h FROM part)")
def img_resize_dims(t: Tables) -> DataFrame:
    w, h = fragments.resize(F.col("p_size"), F.col("p_retailprice"), 10000.0)
    return t.part.select("p_partkey", w.cast("long").alias("width"), h.cast("long").alias("height"))


@query("SELECT CAST(shard AS BIGINT) AS shard, size, coalesce(CAST(sum(size) OVER (ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS start FROM (SELECT shard, count(*) AS size FROM (SELECT ntile(4) OVER (ORDER BY doc_id) - 1 AS shard FROM documents) GROUP BY shard)")
def shard_offsets(t: Tables) -> DataFrame:
    return fragments.shards(t.documents.select("doc_id"), "doc_id", 4)


def wrap_lines(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", F.posexplode(fragments.wrap(F.col("text"), 80)).alias("line_no", "line"))


query()(wrap_lines)

#: Widths in pixels of a proportional font, by rule.
_GLYPHS = {chr(c): 4.0 if chr(c) in "iljtfr.,;:'!|()[] " else 13.0 if chr(c) in "mwMW@" else 10.0 if chr(c).isupper() else 8.0 for c in range(32, 127)}


def wrap_glyphs(t: Tables) -> DataFrame:
    """Documents in lines of 600 pixels, and how many each has."""
    lines = t.documents.select("doc_id", fragments.wrap_pixels(F.col("text"), 600, _GLYPHS, 8.0).alias("x"))
    return lines.select("doc_id", F.size("x").alias("n"), F.element_at("x", 1).alias("first"), F.element_at("x", -1).alias("last"))


query()(wrap_glyphs)


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def dedup_keep_first(t: Tables) -> DataFrame:
    """The lowest doc_id of each text; texts are shuffled as their SHA-256."""
    return t.documents.groupBy(F.sha2("text", 256)).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "copies")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti(t: Tables) -> DataFrame:
    return merge.resume(t.documents.select("doc_id"), t.labels, "doc_id")


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id > (SELECT coalesce(max(doc_id), 0) FROM labels WHERE toxic = 1)")
def resume_watermark(t: Tables) -> DataFrame:
    return merge.above_watermark(t.documents.select("doc_id", "n_chars"), t.labels.where("toxic = 1"), "doc_id")


@query("SELECT count(*) AS total, count(l.doc_id) AS matched, count(*) - count(l.doc_id) AS missing FROM documents LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def coverage_report(t: Tables) -> DataFrame:
    return merge.coverage(t.documents, t.labels, "doc_id")
