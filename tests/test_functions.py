import json
import time

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from gallerylens.functions import chat, html, text as X, vector as V
from gallerylens.operators import textmetrics


def apply(spark, f, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    return [r.x for r in df.select("i", f(F.col("c")).alias("x")).orderBy("i").collect()]


def test_titles_and_artists(spark):
    assert apply(spark, X.clear_title, "Caf&#39;é &amp; Söhne!", "Straße Øst", None, "") == ["cafesohne", "strasseost", None, ""]
    assert apply(spark, X.clear_artist, "José de  Ribera", "Łukasz") == ["jose-de--ribera", "lukasz"]


def test_style_query(spark):
    assert apply(spark, X.style_query, "realism (x) y (z)", "Symbolism", "high renaissance (it)") == ["Realism (arts)", "Symbolism (arts)", "High Renaissance"]


@pytest.mark.parametrize(("raw", "want"), [("The TWO  cats, running!", "2 cats, running"), ("dont know.", "don't know"), ("1,000,000 a", "1000000"), ("it's 3.5", "it's 3 5"), ("", ""), ("the", ""), ("a-b:c", "b:c"), ("x-b:c", "x b:c"), ("no.5 ok", "no 5 ok"), ("Twenty-one", "20 1"), ("1,2", "12"), ("none of a hundred", "none of 100"), ("lets id", "let's i'd"), ("5. x. 2..3", "5 x 2 3"), ("one_two Éa", "one two éa")])
def test_robust_answer(spark, raw, want):
    assert apply(spark, X.robust_answer, raw) == [want]


def test_truncation_keeps_the_period(spark):
    assert apply(spark, lambda c: X.truncate_words(c, 2), "a b c.", "a b", "a b. c.", "a b c") == ["a b.", "a b", "a b.", "a b"]


def test_reference_cleanup(spark):
    assert apply(spark, X.reference_cleanup, "Élan...  Yes.No") == ["elan yes. no"]


@pytest.mark.parametrize(("raw", "want"), [
    ('a {"x": {"y": 1}} {"z": 2}', '{"x": {"y": 1}}'), ("none", None), ('{"a": [1', '{"a": [1'), (None, None), ("}{", "{"),
])
def test_first_object(raw, want):
    assert chat.first_object(raw) == want


def test_repair():
    assert json.loads(chat.repair('x {"b": 2, "a": [1]} y')) == {"a": [1], "b": 2}
    assert json.loads(chat.repair('{"a": "one", "n": 3.5, "t": true, "u" oops')) == {"a": "one", "n": "3.5", "t": True}
    assert json.loads(chat.repair("nothing"))["raw_output"] == "nothing"
    assert json.loads(chat.repair(None))["raw_output"] is None


def test_tool_calls():
    raw = 'Look.\n<tool_call>\n{"name": "f", "arguments": "{\\"q\\": 1}"}\n</tool_call>\n<tool_call>\n{"name": "g", "arguments": {"k": 2}}\n</tool_call><|im_end|>'
    assert json.loads(chat.calls(raw)) == {"content": "Look.", "calls": [{"name": "f", "args": {"q": 1}}, {"name": "g", "args": {"k": 2}}]}
    assert json.loads(chat.calls(None)) == {"content": "", "calls": []}


def test_tool_calls_that_are_left_out():
    raw = "".join(f"<tool_call>\n{c}\n</tool_call>" for c in ("[1, 2]", "no", '{"name": "f", "arguments": "no JSON"}', '"x"', '{"name": "g"}'))
    assert json.loads(chat.calls(raw))["calls"] == [{"name": "g", "args": {}}]


def test_judged():
    assert chat.judged('so {"a": 1}') == {"a": 1}
    assert chat.judged('{"a": 1} and') == {"raw_output": '{"a": 1} and'} and chat.judged("none") == {"raw_output": "none"} and chat.judged(None) == {"raw_output": None}


def test_tool_schema():
    def find(query: str, most: int, state: dict, deep: bool = False):
        """Finds documents.
        Use it often.

        Args:
            query: What to find.
            most: How many.
            state: The graph state.

        Returns:
            list: Documents.
        """

    got = chat.tool_schema(find)["function"]
    assert got["name"] == "find" and got["description"] == "Finds documents.\nUse it often."
    assert got["parameters"] == {"type": "object", "properties": {"query": {"type": "string", "description": "What to find."}, "most": {"type": "integer", "description": "How many."}, "deep": {"type": "boolean"}}, "required": ["query", "most"]}


SYSTEM = "<|im_start|>system\nYou are a helpful assistant."


def test_chat_render_joins_tool_replies(spark):
    rows = [(1, 0, "human", "q"), (1, 1, "ai", "call"), (1, 2, "tool", "r1"), (1, 3, "tool", "r2"), (1, 4, "ai", "end")]
    got = chat.render(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")).first().prompt
    assert got == SYSTEM + "<|im_end|>\n<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\ncall<|im_end|>\n<|im_start|>user\n<tool_response>\nr1\n</tool_response>\n<tool_response>\nr2\n</tool_response><|im_end|>\n<|im_start|>assistant\nend<|im_end|>\n<|im_start|>assistant\n<think>\n"


def test_chat_render_with_calls_and_a_system_turn(spark):
    rows = [(1, 0, "system", "Be brief.", []), (1, 1, "human", "q", []), (1, 2, "ai", "", [("f", "{}"), ("g", '{"k": 1}')]), (1, 3, "system", "again", [])]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string, tool_calls array<struct<name:string,arguments:string>>")
    got = chat.render(df, ['{"t": 1}']).first().prompt
    assert got.startswith("<|im_start|>system\nBe brief.\n\n# Tools\n\nYou may call") and '\n<tools>\n{"t": 1}\n</tools>\n' in got
    assert got.endswith('<|im_start|>assistant\n<tool_call>\n{"name": "f", "arguments": {}}\n</tool_call>\n<tool_call>\n{"name": "g", "arguments": {"k": 1}}\n</tool_call><|im_end|>\n<|im_start|>system\nagain<|im_end|>\n<|im_start|>assistant\n<think>\n')


def test_links(spark):
    page = '<a href="File%3AA%20B.jpg">one</a> <a href="InfoboxHeader%3AC.png">two</a><a href="/x">three</a>'
    got = apply(spark, lambda c: F.transform(html.links(c), lambda x: F.concat_ws("|", x["url"], x["caption"], html.link_kind(x["url"]))), page)[0]
    assert got == ["File%3AA%20B.jpg|one|thumb", "InfoboxHeader%3AC.png|two|infobox", "/x|three"]


def test_paragraphs_ignore_scripts(spark):
    page = '<script>var a = "</p><p>no</p>"</script><p class="x">A &amp; <b>b</b>\n c</p><!-- <p>no</p> --><p>d</p>'
    assert apply(spark, html.paragraphs, page) == [["A & b c", "d"]]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, b array<double>")
    r = df.select(V.norm(F.col("a")).alias("n"), V.l2_normalize(F.col("a")).alias("u"), V.cosine(F.col("a"), F.col("b")).alias("z"), V.sign_bits(F.col("a")).alias("s"), V.l2_normalize(F.col("b")).alias("zero")).first()
    assert (r.n, r.u, r.z, r.s, r.zero) == (5.0, [0.6, 0.8], 0.0, [3], [0.0, 0.0])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=12))
def test_longest_common_subsequence(a, b):
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
    assert textmetrics._lcs(a, b) == table[-1, -1]


def test_image_addresses(spark):
    got = apply(spark, html.candidates, "https://x/a.b/p!q.JPG!Large.jpg!HD.x")[0]
    assert got[0] == "https://x/a.b/p!q.JPG!HD.JPG" and got[-1] == "https://x/a.b/p!q.JPG!PinterestSmall.JPG" and len(got) == 7


@pytest.mark.parametrize(("hyp", "ref", "want"), [("a b\nc d", "c d\na b", 1.0), ("a b c", "a x c", 2 / 3), ("", "a", 0.0), ("a a", "a", 2 / 3), ("the cat\nsat", "the cat sat", 1.0)])
def test_rouge_lsum(hyp, ref, want):
    assert abs(textmetrics._lsum(hyp, ref) - want) < 1e-9


@pytest.mark.parametrize(("raw", "want"), [
    ("They'll save and invest more.", ["They", "'ll", "save", "and", "invest", "more", "."]), ('He said, "I cannot (really) go."', ["He", "said", ",", "``", "I", "can", "not", "(", "really", ")", "go", ".", "''"]),
    ("Good muffins cost $3.88 in New York.", ["Good", "muffins", "cost", "$", "3.88", "in", "New", "York", "."]), ("It's 1,000: don't!", ["It", "'s", "1,000", ":", "do", "n't", "!"]), ("", []),
])
def test_treebank(spark, raw, want):
    assert apply(spark, X.treebank, raw) == [want]


def test_entities(spark):
    import html as library

    raw = "&eacute;&amp;lt; &#233;&#x20AC;&#8364; &Omega; &nosuch; a & b &#0; R&D; &lt;p&gt;"
    assert apply(spark, X.html_unescape, raw, None, "plain") == [library.unescape(raw.replace("&#0;", "@")).replace("@", "&#0;"), None, "plain"]


@pytest.mark.parametrize("dim", [0, 1, 63, 64, 65, 130])
def test_sign_bits_of_any_dimension(spark, dim):
    rng = np.random.default_rng(dim)
    a, b = rng.normal(size=dim).tolist(), rng.normal(size=dim).tolist()
    df = spark.createDataFrame([(a, b)], "a array<double>, b array<double>")
    r = df.select(V.sign_bits(F.col("a")).alias("s"), V.bit_score(V.sign_bits(F.col("a")), V.sign_bits(F.col("b")), dim).alias("n")).first()
    assert len(r.s) == max(1, -(-dim // 64)) and r.n == sum(1 if (x > 0) == (y > 0) else -1 for x, y in zip(a, b))
    assert [w >> i & 1 for w in r.s for i in range(64)][:dim] == [x > 0 for x in a]


def test_json_with_raw_control_characters():
    """The second attempt takes line feeds inside strings, and what follows the value."""
    assert json.loads(chat.repair('{"a": "x\ny", "b": [1, 2]} tail')) == {"a": "x\ny", "b": [1, 2]}
    assert json.loads(chat.repair('so: {"a": "tab\there", "b": {"c": null}}')) == {"a": "tab\there", "b": {"c": None}}


def test_every_character_is_spelled_as_its_decomposition(spark):
    """All of Unicode but surrogates, one row a character, against Python's tables."""
    import unicodedata

    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    rows = ["".join(chars[k : k + 256]) for k in range(0, len(chars), 256)] + ["Tiếng Việt", "ﬁre ﬂag ½ ㎏ ｆｕｌｌ", "plain", "", None]
    want = [None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode() for t in rows]
    assert apply(spark, X.strip_accents, *rows) == want
    odd = [t for c in chars if len(t := unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()) and ord(c) > 127]
    assert len(odd) > 2000
    every = [c for c in chars if ord(c) > 127 and unicodedata.normalize("NFKD", c).encode("ascii", "ignore")]
    assert apply(spark, X.strip_accents, *every) == odd


def test_transliteration(spark):
    assert apply(spark, X.transliterate, "Жостов Щукин", "Ёлка й", "Θεόδωρος Ψ", "Đỗ Łódź Ærø", "漢x") == ["Zhostov Shchukin", "Iolka i", "Theodoros Ps", "Do Lodz AEro", "x"]
    assert apply(spark, X.fold_accents, "Việt ﬁ Ж é", "plain") == ["Viet ﬁ Ж e", "plain"]
    assert apply(spark, X.clear_title, "Nguy&#7877;n &amp; H&#224;") == ["nguyenha"]


def test_letters_take_time_of_the_length(spark):
    """Each letter was tried against a thousand others, one by one."""
    apply(spark, X.strip_accents, "é")
    began = time.perf_counter()
    assert apply(spark, X.strip_accents, "tộ ﬁ " * 200_000) == ["to fi " * 200_000]
    assert time.perf_counter() - began < 5
