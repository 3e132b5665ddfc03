"""What neural models are to the engine: functions of batches, plugged in by the caller, with deterministic stand-ins."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .functions.chat import judged


class Embedder(Protocol):
    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class Classifier(Protocol):
    labels: list[str]

    def scores(self, vectors: np.ndarray) -> np.ndarray: ...


class Generator(Protocol):
    def generate(self, prompts: list[str]) -> list[str]: ...


class Judge(Protocol):
    def accept(self, texts: list[str]) -> list[bool]: ...


class HashEmbedder:
    """Signed hashes of words, summed and brought to unit length."""

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for row, text in zip(out, texts, strict=True):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                row[h % self.dim] += 1 if h >> 63 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


class LengthJudge:
    """Accepts texts of enough words."""

    def __init__(self, least: int = 10) -> None:
        self.least = least

    def accept(self, texts: list[str]) -> list[bool]:
        return [len(t.split()) >= self.least for t in texts]


def embed(df: DataFrame, model: Embedder, id_col: str, text_col: str) -> DataFrame:
    """(id_col, v): texts embedded a batch at a time; a null text as an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = model.embed([t or "" for t in batch.column(text_col).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(v.tolist(), pa.list_(pa.float64()))], [id_col, "v"])

    return df.select(id_col, text_col).mapInArrow(run, f"{id_col} {dict(df.dtypes)[id_col]}, v array<double>")


def judge(df: DataFrame, model: Judge, text_col: str) -> DataFrame:
    """The rows whose text the judge accepts."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.accept([t or "" for t in batch.column(at).to_pylist()]), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def answer(model: Generator, prompt: str, tools: dict, parse, limit: int = 50) -> list[str]:
    """An agent's turns on the driver: generate, run the tools it calls, go on until it calls none or the limit is reached."""
    turns = [prompt]
    for _ in range(limit):
        turns.append(model.generate(["".join(turns)])[0])
        called = parse(turns[-1])
        if not called:
            break
        turns += [str(tools[name](**args)) for name, args in called]
    return turns


#: What a judge scores from 1 to 5.
ASPECTS = ["Semantic Accuracy", "Fluency and Grammar", "Relevance and Saliency", "Specificity", "Creativity and Style"]
#: The orders to the judge and to the questioner.
JUDGE_SYSTEM = f"Score the second of two texts against the first, from 1 (poor) to 5 (perfect), on each of: {', '.join(ASPECTS)}. Answer with one JSON object whose keys are these names, each with its whole number, and explanation, with one sentence that gives the reason."
QUESTION_SYSTEM = "Write a question about the query image, with the phrase \"this image\", whose answer, one sentence, the document holds, without mentioning the document. Answer with a JSON object of question and answer."


def _generated(df: DataFrame, model: Generator, prompt, fields: dict[str, str], read) -> DataFrame:
    """df with the columns of fields (name: type) that read makes of the model's answer to prompt(row)."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"string": pa.string(), "int": pa.int32()}
        for batch in batches:
            answers = model.generate([prompt(r) for r in batch.to_pylist()]) if batch.num_rows else []
            made = [read(a) for a in answers]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([m[n] for m in made], kinds[k]) for n, k in fields.items())], [*names, *fields])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *(f"`{n}` {k}" for n, k in fields.items())])
    return df.mapInArrow(run, schema)


def judge_aspects(pairs: DataFrame, model: Generator, hyp: str = "hyp", refs: str = "refs") -> DataFrame:
    """pairs with a column of 1 to 5 for each aspect, explanation and raw_output (what the judge said, where it is no JSON object).

    Only the first reference of refs, an array, is shown.  A score that is no number from 1 to 5 is null.
    """

    def read(answer: str) -> dict:
        found = judged(answer)
        score = lambda x: x if isinstance(x, int) and not isinstance(x, bool) and 1 <= x <= 5 else None
        told = found.get("explanation")
        return {a: score(found.get(a)) for a in ASPECTS} | {"explanation": told if isinstance(told, str) else None, "raw_output": found.get("raw_output")}

    prompt = lambda r: f"{JUDGE_SYSTEM}\n\nFirst text:\n{(r[refs] or [''])[0]}\n\nSecond text:\n{r[hyp]}"
    return _generated(pairs, model, prompt, dict.fromkeys(ASPECTS, "int") | {"explanation": "string", "raw_output": "string"}, read)


def ask_questions(fragments: DataFrame, model: Generator, text: str = "text") -> DataFrame:
    """fragments with question and answer as the model writes them; both empty where it writes no JSON object with both."""

    def read(answer: str) -> dict:
        found = judged(answer)
        both = [found.get(k) for k in ("question", "answer")]
        return dict(zip(("question", "answer"), both if all(isinstance(x, str) for x in both) else ("", ""), strict=True))

    return _generated(fragments, model, lambda r: f"{QUESTION_SYSTEM}\n\nDocument:\n{r[text] or ''}", {"question": "string", "answer": "string"}, read)
