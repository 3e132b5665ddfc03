"""Chat transcripts and the JSON that models write into them."""

from __future__ import annotations

import inspect
import json
import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

#: How a transcript's roles are named to a model.
ROLES = {"ai": "assistant", "assistant": "assistant", "human": "user", "user": "user", "system": "system", "tool": "tool"}
#: The texts that a prompt is made of besides its turns.
SYSTEM = "You are a helpful assistant."
TOOLS_BEFORE = "\n\n# Tools\n\nYou may call one or more functions to assist with the user query.\n\nYou are provided with function signatures within <tools></tools> XML tags:\n<tools>"
TOOLS_AFTER = '\n</tools>\n\nFor each function call, return a json object with function name and arguments within <tool_call></tool_call> XML tags:\n<tool_call>\n{"name": <function-name>, "arguments": <args-json-object>}\n</tool_call>'
ANSWER = "<|im_start|>assistant\n<think>\n"
_PAIR = re.compile(r'"([^"\\]+)"\s*:\s*(?:"((?:[^"\\]|\\.)*)"|(-?\d+(?:\.\d+)?)|(true|false|null))')
_CALL = re.compile(r"<tool_call>\n(.+?)?\n</tool_call>", re.S)


def role(c: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in ROLES.items() for x in kv))
    return F.try_element_at(table, c)


def first_object(text: str | None) -> str | None:
    """The first {...} with balanced braces; one that is not closed goes to the end; none: None. Braces in strings count, as models rarely escape them."""
    start = -1 if text is None else text.find("{")
    if start < 0:
        return None
    depth = 0
    for k in range(start, len(text)):
        depth += (text[k] == "{") - (text[k] == "}")
        if depth == 0:
            return text[start : k + 1]
    return text[start:]


def repair(text: str | None) -> str:
    """JSON of what an answer's object says: read strictly, then its first whole value with control characters allowed in strings, then pairs found one by one; else an error object."""
    own = first_object(text)
    if own is not None:
        for read in (json.loads, lambda s: json.JSONDecoder(strict=False).raw_decode(s)[0]):
            try:
                return json.dumps(read(own), sort_keys=True)
            except ValueError:
                pass
        pairs = {k: s if not (n or w) else n or {"true": True, "false": False, "null": None}[w] for k, s, n, w in _PAIR.findall(own)}
        if pairs:
            return json.dumps(pairs, sort_keys=True)
    return json.dumps({"error": "no JSON", "raw_output": text})


def calls(text: str | None) -> str:
    """JSON of the content before the first tool call and the calls.

    Arguments may be JSON in a string; a call that is no object, or whose arguments are a string without JSON, is
    left out.
    """
    body = re.sub(r"<\|im_end\|>\s*$", "", text or "")
    found = []
    for inner in _CALL.findall(body):
        try:
            call = json.loads(inner)
            own = call.get("arguments", {}) if isinstance(call, dict) else None
            own = json.loads(own) if isinstance(own, str) else own
        except ValueError:
            continue
        if isinstance(call, dict):
            found.append({"name": call.get("name"), "args": own})
    content = body[: body.find("<tool_call>")] if found else body
    return json.dumps({"content": content.strip(), "calls": found}, sort_keys=True)


def judged(text: str | None) -> dict:
    """What a judge's answer says from its first brace on, read strictly; else the answer itself as raw_output."""
    start = (text or "").find("{")
    try:
        found = json.loads(text[start:]) if start >= 0 else None
    except ValueError:
        found = None
    return found if isinstance(found, dict) else {"raw_output": text}


#: JSON schema types of annotations.
_TYPES = {"str": "string", "int": "integer", "float": "number", "bool": "boolean", "list": "array", "dict": "object"}


def tool_schema(tool: Callable, hidden: Sequence[str] = ("state",)) -> dict:
    """The JSON schema of a tool from its signature and docstring (a description, then Args: lines `name: text`), without hidden parameters."""
    about, _, rest = inspect.cleandoc(tool.__doc__ or "").partition("Args:")
    told = dict(re.findall(r"^[ \t]+(\w+): (.+)$", rest.partition("Returns:")[0], re.M))
    shown = [p for n, p in inspect.signature(tool).parameters.items() if n not in hidden]
    kind = lambda p: _TYPES.get(getattr(p.annotation, "__name__", str(p.annotation)), "string")
    fields = {p.name: {"type": kind(p)} | ({"description": told[p.name].strip()} if p.name in told else {}) for p in shown}
    required = [p.name for p in shown if p.default is inspect.Parameter.empty]
    return {"type": "function", "function": {"name": tool.__name__, "description": about.strip(), "parameters": {"type": "object", "properties": fields, "required": required}}}


def _vectorised(f):
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: f(None if pd.isna(x) else x))

    return run


def json_first_object(c: Column) -> Column:
    return _vectorised(first_object)(c)


def json_repair(c: Column) -> Column:
    return _vectorised(repair)(c)


def tool_calls(c: Column) -> Column:
    return _vectorised(calls)(c)


def render(conv: DataFrame, tools: Sequence[str] = (), key: str = "conv_id") -> DataFrame:
    """(key, prompt) of turns (key, turn, role, text[, tool_calls]): each turn between marks, and the mark under which the model answers.

    A system turn comes first, the usual one if the transcript has none; tools, as JSON, are described in it.
    tool_calls, an array of (name, arguments as JSON), stand behind an assistant's text.  Tool replies one after
    another share one user turn.
    """
    w = Window.partitionBy(key).orderBy("turn")
    near = conv.withColumn("_n", F.row_number().over(w)).withColumn("_before", F.lag("role").over(w)).withColumn("_after", F.lead("role").over(w))
    asks = "tool_calls" in conv.columns
    called = F.col("role").isin("assistant", "ai") & (F.size("tool_calls") > 0) if asks else F.lit(False)
    spoken = F.when(F.col("text") != "", F.concat(F.lit("\n"), "text")).otherwise("")
    one = lambda c: F.concat(F.lit('\n<tool_call>\n{"name": "'), c["name"], F.lit('", "arguments": '), c["arguments"], F.lit("}\n</tool_call>"))
    asked = F.array_join(F.transform("tool_calls", one), "") if asks else F.lit("")
    tool, first_system = F.col("role") == "tool", (F.col("_n") == 1) & (F.col("role") == "system")
    name = F.coalesce(role(F.col("role")), F.col("role"))
    alone = lambda c, mark: F.when(F.coalesce(c, F.lit("")) == "tool", "").otherwise(mark)
    reply = F.concat(alone("_before", "<|im_start|>user"), F.lit("\n<tool_response>\n"), "text", F.lit("\n</tool_response>"), alone("_after", "<|im_end|>\n"))
    turn = F.concat(F.lit("<|im_start|>"), name, F.when(called, F.concat(spoken, asked)).otherwise(F.concat(F.lit("\n"), "text")), F.lit("<|im_end|>\n"))
    part = near.select(key, "turn", F.when(first_system, F.col("text")).alias("system"), F.when(first_system, "").when(tool, reply).otherwise(turn).alias("part"))
    listed = part.groupBy(key).agg(F.max("system").alias("system"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "part"))), lambda s: s["part"]), "").alias("turns"))
    about = "".join([TOOLS_BEFORE, *("\n" + t for t in tools), TOOLS_AFTER]) if tools else ""
    return listed.select(key, F.concat(F.lit("<|im_start|>system\n"), F.coalesce("system", F.lit(SYSTEM)), F.lit(about + "<|im_end|>\n"), "turns", F.lit(ANSWER)).alias("prompt"))
