"""Queries on samples, splits, merges and transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import chat as C, text as X
from ..operators import merge, sampling, textmetrics as M
from .registry import Registry
from .views import Tables

R = Registry()
query = R.query

_SEED = "md5('42:' || o_orderkey), o_orderkey"


@query(f"SELECT o_orderkey, row_number() OVER (ORDER BY {_SEED}) AS place FROM orders")
def seeded_shuffle(t: Tables) -> DataFrame:
    return sampling.shuffle(t.orders.select("o_orderkey"), "o_orderkey").withColumn("place", F.col("place").cast("long"))


@query(f"SELECT o_orderkey, o_orderstatus, CASE WHEN r / n <= 0.85 THEN 'train' ELSE 'test' END AS split FROM (SELECT o_orderkey, o_orderstatus, CAST(row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_SEED}) AS DOUBLE) AS r, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)")
def stratified_split_two(t: Tables) -> DataFrame:
    return sampling.stratified_split(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus", "o_orderkey", [("train", 0.85), ("test", 0.15)])


@query(f"SELECT o_orderkey, o_orderpriority, CASE WHEN r / n <= 0.7 THEN 'train' WHEN r / n <= 0.85 THEN 'val' ELSE 'test' END AS split FROM (SELECT o_orderkey, o_orderpriority, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_SEED}) AS DOUBLE) AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)")
def stratified_split(t: Tables) -> DataFrame:
    return sampling.stratified_split(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", [("train", 0.7), ("val", 0.15), ("test", 0.15)])


@query(f"WITH c AS (SELECT o_orderstatus, count(*) AS c FROM orders GROUP BY 1), s AS (SELECT o_orderstatus, c, CAST(round_even(CAST(100 * c AS DOUBLE) / sum(c) OVER (), 0) AS BIGINT) AS take FROM c), z AS (SELECT o_orderstatus, take + CASE WHEN row_number() OVER (ORDER BY c DESC, o_orderstatus) = 1 THEN 100 - sum(take) OVER () ELSE 0 END AS take FROM s) SELECT o_orderkey, o_orderstatus FROM orders JOIN z USING (o_orderstatus) QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_SEED}) <= any_value(take) OVER (PARTITION BY o_orderstatus)")
def stratified_sample(t: Tables) -> DataFrame:
    return sampling.stratified_sample(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus", "o_orderkey", 100)


_LINES = "WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)"
_LSEED = "md5('42:' || l_orderkey), l_orderkey"


@query(f"{_LINES} (SELECT l_orderkey, n FROM n WHERE n = 3 ORDER BY {_LSEED} LIMIT 50) UNION ALL (SELECT l_orderkey, n FROM n WHERE n > 3 ORDER BY {_LSEED} LIMIT 50)")
def half_half_sample(t: Tables) -> DataFrame:
    sizes = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return sampling.half_half(sizes, "n", 3, "l_orderkey", 100)


def _halves(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Customers with a balance, and customers of some nations under new names; many are both."""
    old = t.customer.where("c_acctbal > 0").select("c_custkey", "c_name")
    return old, t.customer.where("c_nationkey < 15").select("c_custkey", F.concat(F.upper("c_name"), F.lit(" NEW")).alias("c_name"))


@query("SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_name ELSE upper(c_name) || ' NEW' END AS c_name FROM customer WHERE c_acctbal > 0 OR c_nationkey < 15")
def merge_keep_first(t: Tables) -> DataFrame:
    return merge.merge(*_halves(t), ["c_custkey"], new_wins=False)


@query("SELECT c_custkey, CASE WHEN c_nationkey >= 15 THEN c_name ELSE upper(c_name) || ' NEW' END AS c_name FROM customer WHERE c_acctbal > 0 OR c_nationkey < 15")
def merge_last_wins(t: Tables) -> DataFrame:
    return merge.merge(*_halves(t), ["c_custkey"], new_wins=True)


@query("SELECT o_orderkey, CASE raw WHEN 'training' THEN 'train' WHEN 'testing' THEN 'test' WHEN 'valid' THEN 'val' WHEN 'validation' THEN 'val' ELSE raw END AS split FROM (SELECT o_orderkey, ['training', 'testing', 'valid', 'test'][1 + o_orderkey % 4] AS raw FROM orders)")
def split_alias_normalize(t: Tables) -> DataFrame:
    raw = F.element_at(F.array(*map(F.lit, ["training", "testing", "valid", "test"])), (1 + F.col("o_orderkey") % 4).cast("int"))
    table = F.create_map(*map(F.lit, ["training", "train", "testing", "test", "valid", "val", "validation", "val", "train", "train", "test", "test", "val", "val"]))
    split = F.try_element_at(table, raw)
    return t.orders.select("o_orderkey", F.when(split.isNull(), F.raise_error(F.concat(F.lit("no such split: "), raw))).otherwise(split).alias("split"))


@query("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, o_orderkey, o_orderpriority, o_orderstatus FROM orders")
def zip_references(t: Tables) -> DataFrame:
    left = t.orders.select("o_orderkey", "o_orderpriority")
    right = t.orders.select(F.col("o_orderkey").alias("k2"), "o_orderkey", "o_orderstatus")
    a = left.withColumn("image", F.col("o_orderkey"))
    b = right.select("o_orderkey", F.col("k2").alias("image"), "o_orderstatus")
    return merge.zip_rows(a, b, "o_orderkey", "image").select(F.col("pos").cast("long").alias("pos"), "o_orderkey", "o_orderpriority", "o_orderstatus")


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def metric_sum_mean(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"))


_TOK = "list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '')"
#: DuckDB: without ASCII punctuation, and the words of a text.
_BARE = "regexp_replace({}, '[!-/:-@\\[-`{{-~]', '', 'g')"
_WORDS = "list_filter(string_split_regex({}, '\\s+'), lambda w: w <> '')"
_VOCAB = f"SELECT DISTINCT unnest({_WORDS.format(_BARE.format('text'))}) AS token FROM conversations WHERE role = 'user'"


@query(_VOCAB)
def vocab_build(t: Tables) -> DataFrame:
    return M.vocabulary(t.conversations.where("role = 'user'"), "text")


@query(f"WITH v AS ({_VOCAB}), a AS (SELECT conv_id, turn, unnest(range(len(k))) AS pos, unnest(k) AS token FROM (SELECT conv_id, turn, {_WORDS.format('text')} AS k FROM conversations WHERE role = 'assistant')), f AS (SELECT conv_id, turn, list(a.token ORDER BY pos) AS k FROM a JOIN v ON {_BARE.format('a.token')} = v.token GROUP BY conv_id, turn), c AS (SELECT *, array_to_string(k[1:30], ' ') AS cut FROM f) SELECT conv_id, turn, cut || CASE WHEN len(k) > 30 AND ends_with(k[-1], '.') AND NOT ends_with(cut, '.') THEN '.' ELSE '' END AS kept FROM c")
def vocab_filter(t: Tables) -> DataFrame:
    said = t.conversations.where("role = 'assistant'").select("conv_id", "turn", "text")
    return M.in_vocabulary(said, ["conv_id", "turn"], "text", vocab_build(t), 30).withColumnRenamed("text", "kept")


@query("SELECT conv_id, max(turn) AS turn, max_by(role, turn) AS role, max_by(text, turn) AS text FROM conversations GROUP BY conv_id")
def chat_last_message(t: Tables) -> DataFrame:
    return M.last_turns(t.conversations, "conv_id", "turn").select("conv_id", "turn", "role", "text")


@query("SELECT conv_id, turn, role FROM (SELECT *, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS last FROM conversations) WHERE turn > coalesce(last, -1)")
def chat_after_last_user(t: Tables) -> DataFrame:
    last = F.max(F.when(F.col("role") == "user", F.col("turn"))).over(Window.partitionBy("conv_id"))
    return t.conversations.withColumn("last", last).where("turn > coalesce(last, -1)").select("conv_id", "turn", "role")


_SYSTEM = "'<|im_start|>system' || chr(10) || coalesce(max(text) FILTER (turn = first AND role = 'system'), 'You are a helpful assistant.')"
_TURNS = "string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) FILTER (NOT (turn = first AND role = 'system'))"
_MARKED = "(SELECT *, min(turn) OVER (PARTITION BY conv_id) AS first FROM conversations)"


@query(f"SELECT conv_id, {_SYSTEM} || '<|im_end|>' || chr(10) || coalesce({_TURNS}, '') || '<|im_start|>assistant' || chr(10) || '<think>' || chr(10) AS prompt FROM {_MARKED} GROUP BY conv_id")
def chat_render(t: Tables) -> DataFrame:
    return C.render(t.conversations)


_TOOL = '{"type": "function", "function": {"name": "find"}}'
_BLOCK = "chr(10) || chr(10) || '# Tools' || chr(10) || chr(10) || 'You may call one or more functions to assist with the user query.' || chr(10) || chr(10) || 'You are provided with function signatures within <tools></tools> XML tags:' || chr(10) || '<tools>' || chr(10) || '" + _TOOL + "' || chr(10) || '</tools>' || chr(10) || chr(10) || 'For each function call, return a json object with function name and arguments within <tool_call></tool_call> XML tags:' || chr(10) || '<tool_call>' || chr(10) || '{\"name\": <function-name>, \"arguments\": <args-json-object>}' || chr(10) || '</tool_call>'"
_CALLED = "chr(10) || '<tool_call>' || chr(10) || '{\"name\": \"find\", \"arguments\": {\"turn\": ' || turn || '}}' || chr(10) || '</tool_call>'"
_TOOLED = f"CASE WHEN role = 'assistant' AND turn % 4 <> 0 THEN '<|im_start|>assistant' || chr(10) || text || {_CALLED} || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || '<tool_response>' || chr(10) || 'found ' || turn || chr(10) || '</tool_response>' || chr(10) || '<tool_response>' || chr(10) || 'found more' || chr(10) || '</tool_response>' || '<|im_end|>' || chr(10) ELSE '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) END"


@query(f"SELECT conv_id, {_SYSTEM} || {_BLOCK} || '<|im_end|>' || chr(10) || coalesce(string_agg({_TOOLED}, '' ORDER BY turn) FILTER (NOT (turn = first AND role = 'system')), '') || '<|im_start|>assistant' || chr(10) || '<think>' || chr(10) AS prompt FROM {_MARKED} GROUP BY conv_id")
def chat_render_tools(t: Tables) -> DataFrame:
    """Some of the assistant's turns call a tool, which replies twice."""
    asks = (F.col("role") == "assistant") & (F.col("turn") % 4 != 0)
    call = F.array(F.struct(F.lit("find").alias("name"), F.concat(F.lit('{"turn": '), F.col("turn").cast("string"), F.lit("}")).alias("arguments")))
    none = F.array().cast("array<struct<name:string,arguments:string>>")
    turns = t.conversations.select("conv_id", (F.col("turn") * 3).alias("turn"), "role", "text", F.when(asks, call).otherwise(none).alias("tool_calls"), asks.alias("asks"))
    reply = lambda k, text: turns.where("asks").select("conv_id", (F.col("turn") + k).alias("turn"), F.lit("tool").alias("role"), text.alias("text"), none.alias("tool_calls"))
    plain = turns.drop("asks").unionAll(reply(1, F.concat(F.lit("found "), F.expr("string(turn div 3)")))).unionAll(reply(2, F.lit("found more")))
    return C.render(plain, [_TOOL])


#: DuckDB: an answer in the form in which answers are compared; {} is a column.
_RUNS = r"regexp_extract_all(replace(replace(regexp_replace(regexp_replace(lower({}), '([0-9])\.', '\1' || chr(1), 'g'), '\.([0-9])', chr(1) || '\1', 'g'), '.', ''), chr(1), '.'), '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+')"
_ONE = (
    "CASE w WHEN 'zero' THEN '0' WHEN 'one' THEN '1' WHEN 'two' THEN '2' WHEN 'three' THEN '3' WHEN 'four' THEN '4' WHEN 'five' THEN '5' WHEN 'six' THEN '6' WHEN 'seven' THEN '7' WHEN 'eight' THEN '8' WHEN 'nine' THEN '9' WHEN 'ten' THEN '10' WHEN 'eleven' THEN '11' WHEN 'twelve' THEN '12' WHEN 'thirteen' THEN '13' WHEN 'fourteen' THEN '14' WHEN 'fifteen' THEN '15' WHEN 'sixteen' THEN '16' WHEN 'seventeen' THEN '17' WHEN 'eighteen' THEN '18' WHEN 'nineteen' THEN '19' "
    "WHEN 'twenty' THEN '20' WHEN 'thirty' THEN '30' WHEN 'forty' THEN '40' WHEN 'fifty' THEN '50' WHEN 'sixty' THEN '60' WHEN 'seventy' THEN '70' WHEN 'eighty' THEN '80' WHEN 'ninety' THEN '90' WHEN 'hundred' THEN '100' WHEN 'thousand' THEN '1000' WHEN 'a' THEN '' WHEN 'an' THEN '' WHEN 'the' THEN '' WHEN 'im' THEN 'i''m' WHEN 'ive' THEN 'i''ve' WHEN 'id' THEN 'i''d' WHEN 'lets' THEN 'let''s' "
    "ELSE CASE WHEN w IN ('dont', 'cant', 'wont', 'isnt', 'arent', 'wasnt', 'werent', 'didnt', 'hasnt', 'havent', 'wouldnt', 'couldnt', 'shouldnt') THEN w[1:-2] || '''t' WHEN w IN ('youre', 'youve') THEN w[1:3] || '''' || w[4:5] WHEN w IN ('hes', 'shes') THEN w[1:-2] || '''s' ELSE w END END"
)
_COMMAS = r"regexp_replace(regexp_replace(array_to_string(list_transform(" + _RUNS + f", lambda w: {_ONE}), ''), '([0-9]),([0-9])', '\\1\\2', 'g'), '([0-9]),([0-9])', '\\1\\2', 'g')"
_NORMAL = r"trim(regexp_replace(regexp_replace(" + _COMMAS + r", '[!\"#$%&()*+./;<=>?@\[\\\]^_`{{|}}~-]', ' ', 'g'), '\s+', ' ', 'g'))"
#: Texts with what the form changes: numbers, contractions, articles, commas and periods.
_ANSWERS = "text || ' Twenty-one of the ' || turn || ',' || conv_id || ' dont cost 3.5. No.5 is the LETS, an ID; youve 1,2,3..'"


@query(f"SELECT conv_id, turn, {_NORMAL.format('raw')} AS answer FROM (SELECT conv_id, turn, {_ANSWERS} AS raw FROM conversations)")
def vqa_normalize(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", X.robust_answer(F.expr(_ANSWERS)).alias("answer"))


_REFS = "CASE conv_id % 4 WHEN 0 THEN [replace(text, 'e', 'E'), 'The ' || text || '!', text || '..'] WHEN 1 THEN [text || ';', 'no'] WHEN 2 THEN ['no', text || ' x'] ELSE ['an ' || text] END"


@query(f"SELECT conv_id AS id, turn, round(least(coalesce(len(list_filter(refs, lambda r: {_NORMAL.format('r')} = {_NORMAL.format('text')})) / least(len(refs), 3)::DOUBLE, 0), 1), 6) AS score FROM (SELECT *, {_REFS} AS refs FROM conversations)")
def vqa_robust_accuracy(t: Tables) -> DataFrame:
    refs = F.expr(_REFS.replace("[", "array(").replace("]", ")"))
    rows = t.conversations.select(F.struct("conv_id", "turn").alias("id"), F.col("text").alias("pred"), refs.alias("refs"))
    return M.robust_accuracy(rows).select(F.col("id.conv_id").alias("id"), "id.turn", F.round("score", 6).alias("score"))


_OBJECT = """'{"turn": ' || turn || ', "of": {"role": "' || role || '"}}'"""
_SAID = f"CASE turn % 3 WHEN 0 THEN 'say ' || {_OBJECT} || ' done {{\"z\": 2}}' WHEN 1 THEN 'no object' ELSE 'open {{\"turn\": [' || turn END"


@query(f"SELECT conv_id, turn, nullif(regexp_extract(raw, '\\{{[^{{}}]*(?:\\{{[^{{}}]*\\}}[^{{}}]*\\}}|$)'), '') AS object FROM (SELECT conv_id, turn, {_SAID} AS raw FROM conversations)")
def json_first_object(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", C.json_first_object(F.expr(_SAID)).alias("object"))


_BROKEN = f"CASE turn % 3 WHEN 0 THEN 'so: ' || {_OBJECT} WHEN 1 THEN {_OBJECT} || ' and {{more' ELSE '{{\"role\": \"' || role || '\", \"turn\": ' || turn || ', \"last\": true, \"oops' END"


@query("SELECT conv_id, turn, CASE WHEN turn % 3 < 2 THEN '{\"of\": {\"role\": \"' || role || '\"}, \"turn\": ' || turn || '}' ELSE '{\"last\": true, \"role\": \"' || role || '\", \"turn\": \"' || turn || '\"}' END AS json FROM conversations")
def json_repair(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", C.json_repair(F.expr(_BROKEN)).alias("json"))


#: The question mark stands for a backslash, which the two dialects write differently.
_CALLS = """replace('I look.' || chr(10) || '<tool_call>' || chr(10) || CASE turn % 4 WHEN 0 THEN '{"name": "find", "arguments": {"q": ' || turn || '}}' WHEN 1 THEN '{"name": "find", "arguments": "{?"q?": ' || turn || '}"}' WHEN 2 THEN '[1, 2]' ELSE '{"name": "find", "arguments": "no JSON"}' END || chr(10) || '</tool_call><|im_end|>', '?', chr(92))"""


@query("""SELECT conv_id, turn, CASE WHEN turn % 4 < 2 THEN '[{"args":{"q":' || turn || '},"name":"find"}]' ELSE '[]' END AS calls, CASE WHEN turn % 4 < 2 THEN 'I look.' ELSE 'I look.' || chr(10) || '<tool_call>' || chr(10) || CASE turn % 4 WHEN 2 THEN '[1, 2]' ELSE '{"name": "find", "arguments": "no JSON"}' END || chr(10) || '</tool_call>' END AS content FROM conversations""")
def chat_tool_calls(t: Tables) -> DataFrame:
    parsed = t.conversations.select("conv_id", "turn", C.tool_calls(F.expr(_CALLS)).alias("parsed"))
    return parsed.select("conv_id", "turn", F.get_json_object("parsed", "$.calls").alias("calls"), F.get_json_object("parsed", "$.content").alias("content"))


def _texts(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Hypotheses: the last assistant turn of each conversation; references: its user turns."""
    conv = t.conversations
    hyps = M.last_turns(conv.where("role = 'assistant'"), "conv_id", "turn").select(F.col("conv_id").alias("id"), F.col("text").alias("hyp"))
    refs = conv.where("role = 'user'").select(F.col("conv_id").alias("id"), F.col("turn").alias("ref_no"), F.col("text").alias("ref"))
    return hyps.join(refs, "id", "left_semi"), refs.join(hyps, "id", "left_semi")


_T = f"WITH h0 AS (SELECT conv_id AS id, max_by(text, turn) AS hyp FROM conversations WHERE role = 'assistant' GROUP BY conv_id), refs AS (SELECT conv_id AS id, turn AS ref_no, text AS ref FROM conversations WHERE role = 'user' AND conv_id IN (SELECT id FROM h0)), hyps AS (SELECT * FROM h0 WHERE id IN (SELECT id FROM refs)), ht AS (SELECT id, {_TOK.replace('text', 'hyp')} AS k FROM hyps), rt AS (SELECT id, ref_no, {_TOK.replace('text', 'ref')} AS k FROM refs)"


def _grams(n: int) -> str:
    g = f"unnest(list_transform(range(1, len(k) - {n - 2}), lambda i: array_to_string(k[i:i + {n - 1}], ' ')))"
    return f"h{n} AS (SELECT id, g, count(*) AS c FROM (SELECT id, {g} AS g FROM ht) GROUP BY ALL), r{n} AS (SELECT id, ref_no, g, count(*) AS c FROM (SELECT id, ref_no, {g} AS g FROM rt) GROUP BY ALL)"


@query(f"{_T} SELECT id, hyp, len(list(ref))::INT AS n_refs, string_agg(ref, '|' ORDER BY ref_no) AS refs FROM hyps JOIN refs USING (id) WHERE trim(hyp) <> '' AND trim(ref) <> '' GROUP BY id, hyp")
def pair_builder(t: Tables) -> DataFrame:
    return M.pairs(*_texts(t))


_BLEU = ", ".join(f"b{n} AS (SELECT sum(least(h.c, coalesce(m, 0))) AS m, sum(h.c) AS t FROM h{n} h LEFT JOIN (SELECT id, g, max(c) AS m FROM r{n} GROUP BY ALL) USING (id, g))" for n in range(1, 5))
_LEN = "l AS (SELECT sum(h) AS H, sum(r) AS R FROM (SELECT id, len(ht.k) AS h, min_by(len(rt.k), (abs(len(rt.k) - len(ht.k)), len(rt.k))) AS r FROM ht JOIN rt USING (id) GROUP BY id, ht.k))"
_P = [f"ln(greatest(b{n}.m / b{n}.t, 1e-12))" for n in range(1, 5)]


@query(f"{_T}, {', '.join(map(_grams, range(1, 5)))}, {_BLEU}, {_LEN} SELECT " + ", ".join(f"round(CASE WHEN H < R THEN exp(1 - R / H) ELSE 1 END * exp(({' + '.join(_P[:n])}) / {n}), 6) AS bleu{n}" for n in range(1, 5)) + " FROM l, b1, b2, b3, b4")
def bleu_corpus(t: Tables) -> DataFrame:
    return M.bleu(*_texts(t))


@query(f"{_T}, {_grams(1)}, {_grams(2)}, " + ", ".join(f"s{n} AS (SELECT r.id, r.ref_no, sum(CASE WHEN h.c IS NULL THEN 0 ELSE least(r.c, h.c) END) AS s, sum(r.c) AS r FROM r{n} r LEFT JOIN h{n} h USING (id, g) GROUP BY ALL)" for n in (1, 2)) + " " + " UNION ALL ".join(f"SELECT id, {n} AS n, round(max(coalesce(2 * coalesce(s, 0) / nullif(coalesce(r, 0) + coalesce(t, 0), 0), 0)), 6) AS rouge FROM refs LEFT JOIN s{n} USING (id, ref_no) LEFT JOIN (SELECT id, sum(c) AS t FROM h{n} GROUP BY id) USING (id) GROUP BY id" for n in (1, 2)))
def rouge_n(t: Tables) -> DataFrame:
    return M.rouge_n(*_texts(t), (1, 2)).select("id", "n", "rouge")


def rouge_l(t: Tables) -> DataFrame:
    return M.rouge_l(*_texts(t))


def rouge_lsum(t: Tables) -> DataFrame:
    return M.rouge_lsum(*_texts(t))


def meteor_exact(t: Tables) -> DataFrame:
    return M.meteor_exact(*_texts(t))


def meteor(t: Tables) -> DataFrame:
    """With stems, and the matching of fewest crossings."""
    return M.meteor(*_texts(t))


for f in (rouge_l, rouge_lsum, meteor_exact, meteor):
    query()(f)


def _cider(n: int) -> str:
    return (
        f"d{n} AS (SELECT g, count(DISTINCT id) AS df FROM r{n} GROUP BY g), rw{n} AS (SELECT id, ref_no, g, c * (logn - ln(greatest(coalesce(df, 0), 1))) AS w FROM r{n} LEFT JOIN d{n} USING (g) CROSS JOIN total), "
        f"hw{n} AS (SELECT id, g, c * (logn - ln(greatest(coalesce(df, 0), 1))) AS w FROM h{n} LEFT JOIN d{n} USING (g) CROSS JOIN total), "
        f"c{n} AS (SELECT id, avg(coalesce(d / nullif(rn * hn, 0), 0)) AS s FROM refs LEFT JOIN (SELECT id, ref_no, sqrt(sum(w * w)) AS rn FROM rw{n} GROUP BY ALL) USING (id, ref_no) LEFT JOIN (SELECT id, sqrt(sum(w * w)) AS hn FROM hw{n} GROUP BY id) USING (id) LEFT JOIN (SELECT r.id, r.ref_no, sum(r.w * h.w) AS d FROM rw{n} r JOIN hw{n} h USING (id, g) GROUP BY ALL) USING (id, ref_no) GROUP BY id)"
    )


@query(f"{_T}, total AS (SELECT ln(count(DISTINCT id)) AS logn FROM refs), {', '.join(map(_grams, range(1, 5)))}, {', '.join(map(_cider, range(1, 5)))} SELECT id, round(10 * (c1.s + c2.s + c3.s + c4.s) / 4, 5) AS cider FROM c1 JOIN c2 USING (id) JOIN c3 USING (id) JOIN c4 USING (id)")
def cider(t: Tables) -> DataFrame:
    return M.cider(*_texts(t))
