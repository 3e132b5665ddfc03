"""Link prediction with a projection a relation: |M h + r - M t| is small for triples (h, rel, t).

Entities live in one space, each relation sees them through its own matrix M and moves heads to tails there.  A round
compares every triple with one whose tail is drawn anew; gradients are block products over a batch's triples of one
relation.  What leaves a task is a row for each entity of a batch, and for each relation one vector and one matrix.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import groupby
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .graph import Training, _hashed, predict_link
from .retrieval import _matrix

#: Values of all relations' matrices, which are broadcast and may be no more.
RELATION_VALUES = 32 << 20


@dataclass
class Model:
    """entities (id, v); of each relation the vector and the matrix; the mean loss of each round."""

    entities: DataFrame
    relations: dict[str, tuple[np.ndarray, np.ndarray]]
    losses: list[float]


def gradients(m: np.ndarray, r: np.ndarray, head: np.ndarray, tail: np.ndarray, other: np.ndarray, margin: float) -> tuple:
    """(loss, wrong rows, of heads, of tails, of others, of r, of M): of the loss max(0, margin + |M(h-t)+r|^2 - |M(h-o)+r|^2), halved."""
    near, far = head - tail, head - other
    a, b = near @ m.T + r, far @ m.T + r
    loss = np.maximum(margin + (a * a).sum(axis=1) - (b * b).sum(axis=1), 0)
    wrong = np.flatnonzero(loss > 0)
    a, b = a[wrong], b[wrong]
    return loss.sum(), wrong, (a - b) @ m, -a @ m, b @ m, (a - b).sum(axis=0), a.T @ near[wrong] - b.T @ far[wrong]


def train(triples: DataFrame, dim: int = 32, seen: int | None = None, rounds: int = 10, rate: float = 0.3, relation_rate: float = 0.1, margin: float = 1.0, pinned: DataFrame | None = None) -> Model:
    """A model of triples (head, rel, tail): entities of dim values at unit length, but for those of pinned (id, p), which stay; relations see `seen` values (dim).

    Repeated triples count once; an empty table gives a model without entities.  Entities move along the mean of their
    gradients, relations likewise; a relation's vector is no longer than 1.  Each round is written to the shared folder.
    """
    spark, seen = triples.sparkSession, seen or dim
    made = Training(triples, dim, pinned)
    known = [r[0] for r in made.triples.select("rel").distinct().limit(RELATION_VALUES // (seen * (dim + 1)) + 1).collect()]
    if len(known) * seen * (dim + 1) > RELATION_VALUES:
        raise ValueError("more relations than can be shipped")
    start = lambda rel: np.array(spark.range(1).select(_hashed(seen, F.lit(rel))).first()[0])
    relations = {rel: (v / max(np.linalg.norm(v), 1e-12), np.eye(seen, dim)) for rel in sorted(known) for v in [start(rel)]}
    width, losses = seen * (dim + 1), []
    for k in range(rounds if made.n else 0):
        drawn = made.drawn(k).where("other != tail")
        shared = spark.sparkContext.broadcast(relations)

        def run(batches, shared=shared):
            sums: dict[str, list] = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                rels = np.array(batch.column("rel").to_pylist(), object)
                ends = [np.array(batch.column(c).to_pylist(), object) for c in ("head", "tail", "other")]
                vectors = [_matrix(batch.column(f"v_{c}")) for c in ("head", "tail", "other")]
                ids, moves = [], []
                for rel in sorted(set(rels)):
                    rows = np.flatnonzero(rels == rel)
                    r, m = shared.value[rel]
                    loss, wrong, *of_ends, of_r, of_m = gradients(m, r, *(v[rows] for v in vectors), margin)
                    for own, g in zip(ends, of_ends, strict=True):
                        ids.append(own[rows[wrong]])
                        moves.append(g)
                    total = sums.setdefault(rel, [0, 0.0, 0, np.zeros(width)])
                    for i, x in enumerate((len(rows), loss, len(wrong), np.concatenate([of_r, of_m.ravel()]))):
                        total[i] = total[i] + x
                some, place = np.unique(np.concatenate(ids).astype(str), return_inverse=True)
                g, count = np.zeros((len(some), dim)), np.bincount(place, minlength=len(some))
                np.add.at(g, place, np.concatenate(moves))
                yield _rows(0, some.tolist(), count, np.zeros(len(some)), list(g))
            for rel, (count, loss, wrong, g) in sums.items():
                parts = np.zeros((-(-(width + 1) // dim), dim))
                parts.ravel()[: width + 1] = np.append(g, wrong)
                for kind, part in enumerate(parts, 1):  # as long as an entity's
                    yield _rows(kind, [rel], [count], [loss], [part])

        found = drawn.mapInArrow(run, "kind int, key string, n long, loss double, g array<double>")
        # parts of relations: a row a task and part, then one a relation and part
        parts = made.move(made.summed(found, "loss"), rate, "loss").orderBy("key", "kind").collect()
        turned = [SimpleNamespace(id=rel, n=own[0].n, loss=own[0].loss, g=np.concatenate([t.g for t in own])[: width + 1]) for rel, group in groupby(parts, lambda t: t.key) for own in [list(group)]]
        losses.append(sum(t.loss for t in turned) / max(sum(t.n for t in turned), 1))
        for t in turned:
            r, m = relations[t.id]
            g = t.g
            count = max(g[-1], 1)
            r, m = r - relation_rate * g[:seen] / count, m - relation_rate * g[seen:-1].reshape(seen, dim) / count
            relations = relations | {t.id: (r / max(1.0, np.linalg.norm(r)), m)}
    return Model(made.state.select("id", "v"), relations, losses)


_GRADIENTS = pa.schema([("kind", pa.int32()), ("key", pa.string()), ("n", pa.int64()), ("loss", pa.float64()), ("g", pa.list_(pa.float64()))])


def _rows(kind: int, ids: list, counts, losses, g: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([[kind] * len(ids), ids, counts, losses, g], _GRADIENTS.types, strict=True)], schema=_GRADIENTS)


def predict(model: Model, heads: DataFrame, relation: str, candidates: DataFrame | None = None) -> DataFrame:
    """(id, best, score): for each of heads (id), or (id, v) of entities the model has not seen, the entity of candidates (id), or of all, that the relation leads to."""
    r, m = model.relations[relation]
    own = heads if "v" in heads.columns else heads.join(model.entities, "id")
    ends = model.entities if candidates is None else model.entities.join(candidates, "id", "left_semi")
    return predict_link(own.select("id", "v"), ends.select(F.col("id").alias("cid"), F.col("v").alias("c")), r, m)
