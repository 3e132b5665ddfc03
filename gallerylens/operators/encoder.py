"""The attribute classifier's forward pass: task tokens before a document's vectors, encoder layers, a projection.

A document's vectors and the tokens of all tasks (for a label's text: of its task) go through encoder layers, each
self-attention and a feed-forward part, whose sums are brought to mean 0 and variance 1; what has become of the task
tokens is projected.  Batches are Arrow, arithmetic is matrix products over blocks of documents of like length, so that
padding is little and memory bounded.

Weights are named as a state dictionary of the trained network names them, in a NumPy archive that Spark reads, and
are broadcast below WEIGHT_BYTES.
"""

from __future__ import annotations

import io
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .retrieval import _matrix

#: Bytes of weights that may be broadcast, values of one block's attention, labels that are shipped at once.
WEIGHT_BYTES, BLOCK_VALUES, LABEL_ROWS = 256 << 20, 4 << 20, 100_000


def _erf(x: np.ndarray) -> np.ndarray:
    """By the rational approximation with an error of 1.5e-7 at most."""
    t = 1 / (1 + 0.3275911 * np.abs(x))
    series = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return np.sign(x) * (1 - series * np.exp(-x * x))


ACTIVATIONS = {"relu": lambda x: np.maximum(x, 0), "gelu": lambda x: x * (1 + _erf(x / math.sqrt(2))) / 2}


def _normal(x: np.ndarray, weight: np.ndarray, bias: np.ndarray) -> np.ndarray:
    centred = x - x.mean(axis=-1, keepdims=True)
    return centred / np.sqrt((centred * centred).mean(axis=-1, keepdims=True) + 1e-5) * weight + bias


@dataclass
class Network:
    """weights by name, heads of attention, and the feed-forward part's activation."""

    weights: dict[str, np.ndarray]
    heads: int
    activation: str = "relu"

    @property
    def tasks(self) -> int:
        return len(self.weights["task_embeddings_visual"])

    def _encoded(self, side: str, x: np.ndarray, real: np.ndarray, keep: int) -> np.ndarray:
        """The first keep tokens of x (documents, tokens, dimensions) after all layers; real: which tokens are no padding."""
        w, (n, t, d) = self.weights, x.shape
        size, at = d // self.heads, 0
        split = lambda y: y.reshape(n, t, self.heads, size).transpose(0, 2, 1, 3)
        while f"{side}_encoder.layers.{at}.linear1.weight" in w:
            own = lambda name, at=at: w[f"{side}_encoder.layers.{at}.{name}"]
            q, k, v = np.split(x @ own("self_attn.in_proj_weight").T + own("self_attn.in_proj_bias"), 3, axis=2)
            score = split(q) @ split(k).transpose(0, 1, 3, 2) / math.sqrt(size)
            score = np.where(real[:, None, None, :], score, -np.inf)
            score = np.exp(score - score.max(axis=-1, keepdims=True))
            mixed = (score / score.sum(axis=-1, keepdims=True)) @ split(v)
            mixed = mixed.transpose(0, 2, 1, 3).reshape(n, t, d) @ own("self_attn.out_proj.weight").T + own("self_attn.out_proj.bias")
            x = _normal(x + mixed, own("norm1.weight"), own("norm1.bias"))
            inner = ACTIVATIONS[self.activation](x @ own("linear1.weight").T + own("linear1.bias"))
            x = _normal(x + inner @ own("linear2.weight").T + own("linear2.bias"), own("norm2.weight"), own("norm2.bias"))
            at += 1
        return x[:, :keep] @ w[f"{side}_projection.weight"].T

    def _run(self, side: str, tokens: list[np.ndarray], found: list[np.ndarray]) -> np.ndarray:
        """(documents, task tokens, dimensions): found are the documents' vectors, tokens the task tokens of each."""
        keep, d = tokens[0].shape if tokens else (0, 0)
        out = np.zeros((len(found), keep, self.weights[f"{side}_projection.weight"].shape[0]))
        order, at = np.argsort([-len(v) for v in found], kind="stable"), 0
        while at < len(order):
            longest = keep + len(found[order[at]])
            rows = order[at : at + max(1, BLOCK_VALUES // (longest * (longest * self.heads + 4 * d)))]
            x, real = np.zeros((len(rows), longest, d)), np.zeros((len(rows), longest), bool)
            for i, r in enumerate(rows):
                n = keep + len(found[r])
                x[i, :keep], real[i, :n] = tokens[r], True
                if n > keep:
                    x[i, keep:n] = found[r]
            out[rows] = self._encoded(side, x, real, keep)
            at += len(rows)
        return out

    def visual(self, found: list[np.ndarray]) -> np.ndarray:
        """(documents, tasks, dimensions)."""
        return self._run("visual", [self.weights["task_embeddings_visual"]] * len(found), found)

    def text(self, found: list[np.ndarray], tasks: list[int]) -> np.ndarray:
        """(texts, dimensions) of texts for a task each."""
        return self._run("text", [self.weights["task_embeddings_text"][[t]] for t in tasks], found)[:, 0] if found else np.zeros((0, 0))


def load(spark: SparkSession, path: str, heads: int, activation: str = "relu") -> Network:
    """The network of an archive (.npz) at a path that Spark can read; weights that both sides share are stored under either name."""
    held = spark.read.format("binaryFile").load(path).select("length", "content")
    size = held.agg(F.sum("length")).first()[0]
    if not size or size > WEIGHT_BYTES:
        raise ValueError(f"{path}: no weights, or more than {WEIGHT_BYTES} bytes of them")
    archive = np.load(io.BytesIO(bytes(held.first()["content"])))
    return Network({k: archive[k].astype(np.float64) for k in archive.files}, heads, activation)


def random_network(dim: int, tasks: int, layers: int = 2, heads: int = 4, inner: int = 128, out: int | None = None, seed: int = 42) -> Network:
    """An untrained network, the same for the same seed."""
    rng, w = np.random.default_rng(seed), {}
    make = lambda *shape: rng.standard_normal(shape) / math.sqrt(shape[-1])
    for side in ("text", "visual"):
        w[f"task_embeddings_{side}"] = make(tasks, dim)
        w[f"{side}_projection.weight"] = make(out or dim, dim)
        for k in range(layers):
            shapes = {"self_attn.in_proj_weight": (3 * dim, dim), "self_attn.in_proj_bias": (3 * dim,), "self_attn.out_proj.weight": (dim, dim), "self_attn.out_proj.bias": (dim,), "linear1.weight": (inner, dim), "linear1.bias": (inner,), "linear2.weight": (dim, inner), "linear2.bias": (dim,), "norm1.bias": (dim,), "norm2.bias": (dim,)}
            w |= {f"{side}_encoder.layers.{k}.{n}": make(*s) for n, s in shapes.items()} | {f"{side}_encoder.layers.{k}.norm{i}.weight": 1 + make(dim) for i in (1, 2)}
    return Network(w, heads)


def _vectors(column: pa.ListArray) -> list[np.ndarray]:
    """A null row, and one without vectors, has none."""
    return [np.array(v, np.float64) if v else np.zeros((0, 0)) for v in column.to_pylist()]


def embed_images(images: DataFrame, network: Network) -> DataFrame:
    """(id, task, v): what each task says of images (id, vs); one without vectors has what the task tokens alone say."""
    shared = images.sparkSession.sparkContext.broadcast(network)  # below WEIGHT_BYTES

    def run(batches):
        for batch in batches:
            made = shared.value.visual(_vectors(batch.column("vs")))
            n, tasks = made.shape[:2]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(np.repeat(np.arange(n), tasks))), pa.array(np.tile(np.arange(tasks, dtype=np.int32), n)), pa.array(list(made.reshape(n * tasks, -1)), pa.list_(pa.float64()))], ["id", "task", "v"])

    return images.select(F.col("id").cast("long").alias("id"), F.col("vs").cast("array<array<double>>").alias("vs")).mapInArrow(run, "id long, task int, v array<double>")


def embed_labels(labels: DataFrame, network: Network) -> DataFrame:
    """(task, label, v) of labels (task, label, vs: their texts' vectors)."""
    shared = labels.sparkSession.sparkContext.broadcast(network)

    def run(batches):
        for batch in batches:
            made = shared.value.text(_vectors(batch.column("vs")), batch.column("task").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("task"), batch.column("label"), pa.array(list(made), pa.list_(pa.float64()))], ["task", "label", "v"])

    return labels.select(F.col("task").cast("int").alias("task"), F.col("label").cast("string").alias("label"), F.col("vs").cast("array<array<double>>").alias("vs")).mapInArrow(run, "task int, label string, v array<double>")


def label_scores(images: DataFrame, labels: DataFrame, scale: float = math.log(10), bias: float = -10.0, k: int | None = 5, least: float = 0.0) -> DataFrame:
    """(id, task, label, score, rank): the k labels of each image and task of the largest sigmoid(exp(scale) * cosine + bias), at least least.

    images are (id, task, v), labels (task, label, v).  Labels, of which there may be LABEL_ROWS, are shipped; scores are
    one product a task and batch, of which only the k best leave it.  Ties go by the label.
    """
    spark = images.sparkSession
    held = labels.select("task", "label", "v").orderBy("task", "label").limit(LABEL_ROWS + 1).toPandas()
    if len(held) > LABEL_ROWS:
        raise ValueError(f"more than {LABEL_ROWS} labels")
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    shared = spark.sparkContext.broadcast({int(t): (own["label"].tolist(), unit(np.array(own["v"].tolist(), np.float64))) for t, own in held.groupby("task")})
    kinds = {"id": pa.int64(), "task": pa.int32(), "label": pa.string(), "score": pa.float64(), "rank": pa.int32()}

    def run(batches):
        for batch in batches:
            ids, tasks = batch.column("id").to_numpy(zero_copy_only=False), batch.column("task").to_numpy(zero_copy_only=False)
            for t in np.unique(tasks).tolist():
                if t not in shared.value:
                    continue
                names, m = shared.value[t]
                rows = np.flatnonzero(tasks == t)
                score = 1 / (1 + np.exp(-(math.exp(scale) * unit(_matrix(batch.column("v").take(pa.array(rows)))) @ m.T + bias)))
                best = np.argsort(-score, axis=1, kind="stable")[:, : k or len(names)]
                top = np.take_along_axis(score, best, axis=1)
                i, j = np.nonzero(top >= least)
                columns = [ids[rows[i]], np.full(len(i), t), [names[x] for x in best[i, j].tolist()], top[i, j], j + 1]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds.values(), strict=True)], list(kinds))

    return images.select(F.col("id").cast("long").alias("id"), F.col("task").cast("int").alias("task"), F.col("v").cast("array<double>").alias("v")).mapInArrow(run, "id long, task int, label string, score double, rank int")
