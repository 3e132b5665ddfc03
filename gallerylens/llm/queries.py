"""One query per operator over whole tables, and DuckDB SQL where it can express the result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import alignment, bpe, exact, lexical, licenses, packing, piece_bpe, quality, secret_scan, simhash, suffix, toxicity, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_table(spark, sf_dir, "documents")).drop("chars_distance", "words_distance")


def op4_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(_table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


def op6_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(_table(spark, sf_dir, "documents")).drop("spans")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(_table(spark, sf_dir, "pages"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = secret_scan.spans_digest(F.col("base"))
    return secret_scan.scan_secrets(_table(spark, sf_dir, "documents")).select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(base, 256).alias("base_sha256"), secret_scan.spans_digest(F.col("found")).alias("spans"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), with_groups=False)


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.encode_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), with_ids=False)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash, op2_packing, op3_quality, op4_exact, op5_bpe, op6_suffix, op7_toxicity, op8_urls, op9_secrets, op10_licenses, op11_alignment, op12_lexical, op13_sentencepiece)}


_OP4 = r"""
WITH n AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
r AS (SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size, first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS keep_id FROM n)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM r
"""

_OP8 = r"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
rules(action, h, pre) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
listed(d) AS (VALUES ('casino-bonus.example.com'), ('cheap-pills.example.com'), ('spam-farm.example.org'), ('free-prizes.example.net')),
fits AS (SELECT page_id, max_by(h || pre, length(h || pre)) AS rule, max_by(action, length(h || pre)) AS action
  FROM (SELECT DISTINCT page_id, host, path FROM p) JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN EXISTS (SELECT 1 FROM listed WHERE host = d OR ends_with(host, '.' || d)) THEN 'block' ELSE 'allow' END) AS verdict FROM p LEFT JOIN fits USING (page_id)
"""


_OP12 = r"""
WITH low AS (SELECT {id} AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM {table})
SELECT id, term, CAST(count(*) AS BIGINT) AS tf FROM low GROUP BY id, term
"""
_OP12 = rf"""
WITH d AS ({_OP12.format(id="doc_id", table="documents")}), q AS ({_OP12.format(id="item_id", table="benchmark")}),
l AS (SELECT id, CAST(sum(tf) AS BIGINT) AS n FROM d GROUP BY id), s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM l),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM d, s GROUP BY term, docs),
m AS (SELECT id, 100 - 75 + ((75 * n * docs) // length) AS m FROM l, s),
r AS (SELECT q.id AS item_id, d.id AS doc_id, CAST(sum(q.tf * w * ((1000000000 * d.tf) // (1000 * d.tf + 8 * m))) AS BIGINT) AS score FROM q JOIN d USING (term) JOIN w USING (term) JOIN m ON m.id = d.id GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0 QUALIFY rank <= 10
"""


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _op3() -> str:
    """Histograms in long form: one row for each document, kind of histogram and class. The common words are the operator's; all patterns and limits are written out."""
    classes = ", ".join(f"len(regexp_extract_all(t, {_quoted([p])}))" for p in ("[A-Z]", "[a-z]", "[0-9]", r"[.,;:!?'\"()\-]", "[#*$%&|<>]"))
    common = " ".join(f"WHEN '{lang}' THEN [{_quoted(words)}]" for lang, words in quality.COMMON_WORDS.items())
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS lang FROM documents),
w AS (SELECT doc_id, t, lang, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
f AS (SELECT doc_id, lang, t, len(ws) AS n_words, coalesce(length(array_to_string(ws, '')), 0) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
  CASE lang {common} END AS common, regexp_extract_all(lower(t), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS runs, [{classes}] AS cs FROM w LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
hits AS (SELECT *, list_transform(common, lambda c: len(list_filter(runs, lambda r: r = c))) AS hs, list_append(cs, length(t) - word_chars) AS ds FROM b),
hist AS (SELECT doc_id, lang, base_failed, 'c' AS kind, unnest(range(7)) AS i, unnest(list_append(ds, length(t) - list_sum(ds))) AS v FROM hits
  UNION ALL SELECT doc_id, lang, base_failed, 'w', unnest(range(31)), unnest(list_append(hs, greatest(n_words - list_sum(hs), 0))) FROM hits WHERE common IS NOT NULL),
ref AS (SELECT lang, kind, i, sum(v) AS q FROM hist WHERE NOT base_failed GROUP BY ALL),
sh AS (SELECT doc_id, kind, v / nullif(sum(v) OVER (PARTITION BY doc_id, kind), 0) AS p, q / nullif(sum(q) OVER (PARTITION BY doc_id, kind), 0) AS q FROM hist JOIN ref USING (lang, kind, i)),
js AS (SELECT doc_id, kind, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 0)) AS far FROM sh GROUP BY doc_id, kind),
bad AS (SELECT DISTINCT doc_id FROM js JOIN b USING (doc_id) WHERE CASE kind WHEN 'c' THEN far > 0.35 AND length(t) >= 400 ELSE far > 0.5 AND n_words >= 100 END)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (FROM bad) AS kept FROM b
"""


#: (kind, pattern, group with a least length, that length), in the order that breaks ties; runs of 24 and more are the runs of any length that have 24.
_SECRETS = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"(AKIA[A-Z0-9]+)", 1, 20),
    ("hex", r"([0-9a-f]{24,})", 1, 24),
    ("key", r"([A-Za-z0-9/+=]+)", 1, 40),
    ("login", r"""((?i:user_?name|user|login|client_?id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@-]+)""", 2, 3),
    ("endpoint", r"""([A-Za-z][A-Za-z0-9+.-]{0,31}://[^\x00-\x20"'<>]+)""", 1, 8),
]


def _op9() -> str:
    """Positions from the gaps between matches; a key is a run of its characters and '=' that is 40 long and without '='."""

    def found(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
        text = _quoted([pattern])
        return (
            f"SELECT doc_id, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s, length(m[i]) AS n, {rank} AS rank, '{kind}' AS kind "
            f"FROM (SELECT doc_id, g, m, h, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, string_split_regex(t, {text}) AS g, regexp_extract_all(t, {text}, 0) AS m, regexp_extract_all(t, {text}, {group}) AS h FROM d WHERE regexp_matches(t, {text}))) WHERE length(h[i]) >= {least}"
        )

    finds = [(r[0], found(n, *r)) for n, r in enumerate(_SECRETS)]
    parts = " UNION ALL ".join(q if kind != "key" else f"SELECT k.* FROM ({q}) k JOIN d USING (doc_id) WHERE n = 40 AND NOT contains(substr(t, s + 1, 40), '=')" for kind, q in finds)
    near = lambda kinds: f"EXISTS (SELECT 1 FROM p o WHERE o.doc_id = p.doc_id AND o.kind IN ({kinds}) AND o.s <= p.e + 300 AND o.e >= p.s - 300)"
    ids, secrets = near("'access', 'login'"), near("'assign', 'hex', 'key'")
    spans = "coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank){}, '')"
    count = lambda kind: f"count(*) FILTER (kind = '{kind}') AS n_{kind}"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), p AS (SELECT doc_id, s, s + n AS e, rank, kind FROM ({parts})),
l AS (SELECT * FROM p WHERE rank < 3 OR (kind = 'key' AND {ids}) OR (kind = 'login' AND {secrets}) OR (kind = 'endpoint' AND {ids} AND {secrets}))
SELECT doc_id, {count("assign")}, {count("access")}, {count("hex")}, sha256({spans.format(" FILTER (rank < 3)")}) AS base_sha256, {spans.format("")} AS spans FROM d LEFT JOIN l USING (doc_id) GROUP BY doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_quality": _op3(), "op4_exact": _OP4, "op8_urls": _OP8, "op9_secrets": _op9(), "op12_lexical": _OP12}
