"""Property graphs as nodes (id, label, name) and edges (head, rel, tail)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import vector as V
from .ranks import ranked, small
from .retrieval import _blocks, _matrix
from .scratch import stored


def nodes_by_type(nodes: DataFrame, label: str) -> DataFrame:
    return nodes.where(F.col("label") == label).select("id", "name")


def edges_by_type(edges: DataFrame, rel: str) -> DataFrame:
    return edges.where(F.col("rel") == rel).select("head", "tail")


def relation_types(edges: DataFrame) -> DataFrame:
    return edges.select("rel").distinct()


def nodes_by_id(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """ids (pos, id): nodes in the order of pos; ids that no node has are dropped."""
    return ids.join(nodes, "id").select("pos", "id", "label", "name")


def neighbors(edges: DataFrame, rel: str | None = None) -> DataFrame:
    """(head, tails): each head's tails in order, of one relation or all."""
    chosen = edges if rel is None else edges.where(F.col("rel") == rel)
    return chosen.groupBy("head").agg(F.array_join(F.sort_array(F.collect_list("tail")), "|").alias("tails"))


def neighbors_undirected(edges: DataFrame, nodes: DataFrame, ids: list[str]) -> DataFrame:
    """Neighbours in either direction of a few nodes: (id, neighbour's label, count)."""
    some = edges.where(F.col("head").isin(ids)).select(F.col("head").alias("id"), F.col("tail").alias("other"))
    back = edges.where(F.col("tail").isin(ids)).select(F.col("tail").alias("id"), F.col("head").alias("other"))
    return some.unionAll(back).join(nodes.select(F.col("id").alias("other"), "label"), "other").groupBy("id", "label").agg(F.count("*").alias("n"))


def two_hops(edges: DataFrame, first: str, second: str) -> DataFrame:
    """How often a tail of first and a tail of second share a head."""
    a = edges_by_type(edges, first).withColumnRenamed("tail", "a")
    return a.join(edges_by_type(edges, second).withColumnRenamed("tail", "b"), "head").groupBy("a", "b").agg(F.count("*").alias("n"))


def adjacency(edges: DataFrame) -> DataFrame:
    """(head, rel, tails)."""
    return edges.groupBy("head", "rel").agg(F.array_join(F.sort_array(F.collect_list("tail")), "|").alias("tails"))


def label_counts(edges: DataFrame, least: int = 0) -> DataFrame:
    """(rel, tail, n) of labels used at least so often."""
    return edges.groupBy("rel", "tail").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def prolific_tails(edges: DataFrame, rel: str, more_than: int) -> DataFrame:
    return edges_by_type(edges, rel).groupBy("tail").agg(F.count("*").alias("n")).where(F.col("n") > more_than)


def class_weights(edges: DataFrame) -> DataFrame:
    """Inverse frequency of each label within its relation."""
    return label_counts(edges).select("rel", "tail", "n", F.round(F.lit(1.0) / F.col("n"), 6).alias("weight"))


def triples_excluding(edges: DataFrame, held_out: DataFrame) -> DataFrame:
    """Edges of which neither end is in held_out (id): two anti-joins rather than one on either end."""
    return edges.join(held_out.select(F.col("id").alias("head")), "head", "left_anti").join(held_out.select(F.col("id").alias("tail")), "tail", "left_anti").select("head", "rel", "tail")


def decode_labels(edges: DataFrame, nodes: DataFrame, mode: str = "both") -> DataFrame:
    """Each head's labels by relation as 'id', 'name' or 'id:name' of 'both', in the order of the ids."""
    named = edges.join(nodes.select(F.col("id").alias("tail"), "name"), "tail", "left")
    text = {"id": lambda x: x["tail"], "name": lambda x: x["name"], "both": lambda x: F.concat_ws(":", x["tail"], x["name"])}[mode]
    return named.groupBy("head", "rel").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("tail", "name"))), text), "|").alias("labels"))


def upsert_props(updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One (id, field, value) for each cell that is not null; a cell that is null sets nothing."""
    long = updates.unpivot(key, [F.col(c).cast("string").alias(c) for c in columns], "field", "value")
    return long.where("value is not null").withColumnRenamed(key, "id")


def apply_props(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """nodes (id, props map) with (id, field, value) set; new values win."""
    new = changes.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("new"))
    old = F.coalesce("props", F.create_map().cast("map<string,string>"))
    new_or_none = F.coalesce("new", F.create_map().cast("map<string,string>"))
    merged = F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new_or_none, k)), new_or_none)
    return nodes.join(new, "id", "left").withColumn("props", merged).drop("new")


def entity_mapping(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """wanted (id) with the position of each among the sorted distinct known (id), null and missing where unknown."""
    order = ranked(known.select("id").distinct(), ["id"], name="position")
    return wanted.select("id").distinct().join(order, "id", "left").select("id", "position", F.col("position").isNull().alias("missing"))


def closure(children: DataFrame, roots: DataFrame, max_depth: int) -> DataFrame:
    """(node, depth): nodes reachable from roots (node) over children (parent, child), at their smallest depth.

    Nodes are expanded while their depth is at most max_depth, so nodes of one level more are reached.  Each
    level is one join and one anti-join with what was visited, written to the shared folder.
    """
    visited = stored(roots.select("node").distinct().withColumn("depth", F.lit(0)), "closure")
    frontier = visited
    for depth in range(1, max_depth + 2):
        step = frontier.join(children, frontier["node"] == children["parent"]).select(F.col("child").alias("node")).distinct()
        frontier = stored(step.join(visited, "node", "left_anti").withColumn("depth", F.lit(depth)), "closure")
        if frontier.isEmpty():
            break
        visited = visited.unionAll(frontier)
    return visited


def predict_link(heads: DataFrame, candidates: DataFrame, relation: np.ndarray | None = None, projection: np.ndarray | None = None) -> DataFrame:
    """(id, best, score): for each head (id, v) the candidate (cid, c) with the largest -|Pv + relation - Pc|; ties to the smallest cid.

    Candidates are shipped in blocks, whatever their number, and a batch of heads is scored by one product a block: a
    row for each head and block, not for each pair, leaves a task.  Without a projection P both are taken as they are.
    """
    spark, out = heads.sparkSession, None
    kind, arrow = candidates.schema["cid"].dataType.simpleString(), to_arrow_type(candidates.schema["cid"].dataType)
    seen = (lambda m: m) if projection is None else (lambda m: m @ projection.T)
    for ids, matrix in _blocks(candidates, "cid", "c"):
        order = np.array(sorted(range(len(ids)), key=lambda i: ids[i]))
        shared = spark.sparkContext.broadcast(([ids[i] for i in order], seen(matrix[order])))

        def score(batches, shared=shared):
            names, c = shared.value
            square = (c * c).sum(axis=1)
            for batch in batches:
                if not batch.num_rows:
                    continue
                moved = seen(_matrix(batch.column("v"))) + (0 if relation is None else relation)
                best, far = np.zeros(len(moved), np.int64), np.zeros(len(moved))
                for at in range(0, len(moved), 512):
                    x = moved[at : at + 512]
                    near = (x * x).sum(axis=1)[:, None] + square - 2 * x @ c.T
                    least = near.min(axis=1, keepdims=True)
                    # products lose the last digits: what is as near is measured by itself, and the first of equal ones taken
                    for i, j in enumerate(near <= least + 1e-9 * (1 + np.abs(least))):
                        some = np.flatnonzero(j)
                        own = np.sqrt(((x[i] - c[some]) ** 2).sum(axis=1))
                        best[at + i], far[at + i] = some[own.argmin()], own.min()
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([names[i] for i in best.tolist()], arrow), pa.array(-far)], ["id", "cid", "score"])

        found = heads.select("id", F.col("v").cast("array<double>").alias("v")).mapInArrow(score, f"id {heads.schema['id'].dataType.simpleString()}, cid {kind}, score double")
        out = found if out is None else out.unionAll(found)
    if out is None:
        return heads.limit(0).select("id", F.lit(None).cast(kind).alias("best"), F.lit(None).cast("double").alias("score"))
    best = out.groupBy("id").agg(F.max("score").alias("score"), F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "cid")))[0].alias("b"))  # a row a block
    return best.select("id", F.col("b.cid").alias("best"), "score")


def constrain(vectors: DataFrame, pinned: DataFrame) -> DataFrame:
    """vectors (id, v) brought to unit length, but for those of pinned (id, p), which keep their fixed vector."""
    return vectors.join(pinned, "id", "left").select("id", F.coalesce("p", V.l2_normalize(F.col("v"))).alias("v"), F.col("p").isNotNull().alias("pinned"))


#: Tails of the most triples: each round their vectors are broadcast, as many as these at most.
HOT = 10_000


def _hashed(dim: int, *key):
    return F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: F.pmod(F.xxhash64(*key, i), F.lit(2_000_003)) / 1_000_001.5 - 1)


class Training:
    """What the rounds of training share: distinct triples (head, rel, tail), and the state (kind 0, key, id, place, v), a row for each entity; place numbers the tails by id and is null for others.

    Vectors are unit vectors by a hash of the id at first.  Those of pinned (id, p) stay.
    """

    def __init__(self, triples: DataFrame, dim: int, pinned: DataFrame | None) -> None:
        self.dim, self.pinned = dim, pinned
        self.triples = stored(triples.select("head", "rel", "tail").distinct(), "triples")
        names = self.triples.select(F.col("head").alias("id")).unionAll(self.triples.select("tail")).distinct()
        order = stored(ranked(self.triples.select(F.col("tail").alias("id")).distinct(), ["id"], name="place"), "places")
        self.n = order.count()
        counts = self.triples.where("tail is not null").groupBy("tail").count()
        self.hot = stored(counts.orderBy(F.desc("count"), "tail").limit(HOT).select("tail"), "hot-tails")
        placed = names.join(small(order), "id", "left").select(F.lit(0).alias("kind"), F.col("id").cast("string").alias("key"), "id", "place")
        begun = self.start(F.col("id"))
        # without pins the first vectors follow from the ids: no row has to carry or look them up
        self.state = stored(placed, "entities").withColumn("v", begun) if pinned is None else stored(self._pinned(placed.withColumn("v", begun)), "entities")
        self.begun = pinned is not None

    def start(self, id: Column) -> Column:
        return V.l2_normalize(_hashed(self.dim, id))

    def _pinned(self, df: DataFrame) -> DataFrame:
        if self.pinned is None:
            return df
        return df.join(self.pinned.select("id", "p"), "id", "left").withColumn("v", F.coalesce("p", "v")).select(*df.columns)

    def drawn(self, k: int) -> DataFrame:
        """Triples with another tail, drawn among all tails by a hash of the triple and the round k, and v_head, v_tail, v_other.

        What is drawn is joined last: rows travel once with the vectors of head and of a tail that is not hot.
        """
        ends, tails = ["head", "tail", "other"], self.state.where("place is not null")
        place = F.pmod(F.xxhash64("head", "rel", "tail", F.lit(k)), F.lit(self.n))
        rows = self.triples.where("head is not null and rel is not null and tail is not null").withColumn("place", place)
        if not self.begun:
            found = rows.join(small(tails.select("place", F.col("id").alias("other"))), "place").drop("place")
            return found.select("*", *(self.start(F.col(c)).alias(f"v_{c}") for c in ends))
        own = tails.select(F.col("id").alias("tail"), F.col("v").alias("v_tail"))
        hot = self.hot.withColumn("hot", F.lit(True))
        common = F.broadcast(own.join(F.broadcast(self.hot), "tail").withColumnRenamed("v_tail", "v_hot"))
        marked = rows.join(F.broadcast(hot), "tail", "left")
        rare = marked.where("hot is null").drop("hot").join(own, "tail")
        rows = rare.unionByName(marked.where("hot").drop("hot").withColumn("v_tail", F.lit(None).cast("array<double>")))
        rows = rows.join(self.state.select(F.col("id").alias("head"), F.col("v").alias("v_head")), "head")
        rows = rows.join(small(tails.select("place", F.col("id").alias("other"), F.col("v").alias("v_other"))), "place").drop("place")
        return rows.join(common, "tail", "left").withColumn("v_tail", F.coalesce("v_tail", "v_hot")).drop("v_hot")

    def move(self, moves: DataFrame, rate: float, *sums: str) -> DataFrame:
        """Moves entities against the mean of moves (kind, key, n, g: sums of n gradients, more sums) of kind 0; the rows of other kinds, which are returned, are written beside them."""
        step = F.when(F.col("g").isNull(), F.col("v")).otherwise(F.zip_with("v", "g", lambda x, y: x - rate * y / F.col("n")))
        unit = F.when(F.col("kind") == 0, V.l2_normalize(step))
        joined = self.state.join(moves, ["kind", "key"], "full").select("kind", "key", "id", "place", unit.alias("v"), *(F.when(F.col("kind") > 0, F.col(c)).alias(c) for c in ("n", "g", *sums)))
        out = stored(self._pinned(joined), "entities")
        self.state, self.begun = out.where("kind = 0").select("kind", "key", "id", "place", "v"), True
        return out.where("kind > 0").select("kind", "key", "n", "g", *sums)

    def summed(self, gradients: DataFrame, *sums: str) -> DataFrame:
        """moves of gradients (kind, key, n, g, more sums), whose elements are summed before the shuffle too."""
        g = F.array(*(F.sum(F.get("g", F.lit(i))) for i in range(self.dim)))
        return gradients.groupBy("kind", "key").agg(F.sum("n").alias("n"), g.alias("g"), *(F.sum(c).alias(c) for c in sums))


def train_links(triples: DataFrame, dim: int = 32, rounds: int = 10, rate: float = 0.3, margin: float = 1.0, pinned: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Entity vectors (id, v) and relation vectors (rel, v) by which h + r lies nearer to t than to another entity, of triples (head, rel, tail).

    Each round compares every triple with one whose tail is drawn anew among all tails, by a hash of the triple and the round; where
    the margin is not kept, head, relation and both tails move along the mean of their gradients.  Entities have unit
    length, but for those of pinned (id, p), which keep their vectors.  Gradients are summed an element at a time by
    the aggregation, before the shuffle too, and are not written; a round's vectors are, to the shared folder.
    """
    made = Training(triples, dim, pinned)
    relations = stored(made.triples.select("rel").distinct().select("rel", V.l2_normalize(_hashed(dim, "rel")).alias("v")), "relations")
    minus = lambda a, b: F.zip_with(a, b, lambda x, y: x - y)
    square = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)
    for k in range(rounds if made.n else 0):
        drawn = made.drawn(k).join(small(relations.select("rel", F.col("v").alias("v_rel"))), "rel")
        moved = F.zip_with("v_head", "v_rel", lambda x, y: x + y)
        apart = drawn.where("other != tail").withColumn("h", moved).withColumns({"a": minus("h", "v_tail"), "b": minus("h", "v_other")})
        wrong = apart.where(square("a") + margin > square("b")).withColumn("c", minus("a", "b"))
        of = lambda kind, key, g: F.struct(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key"), F.lit(1).cast("long").alias("n"), g.alias("g"))
        parts = [of(0, "head", F.col("c")), of(0, "tail", F.transform("a", lambda x: -x)), of(0, "other", F.col("b")), of(1, "rel", F.col("c"))]
        turns = made.move(made.summed(wrong.select(F.explode(F.array(*parts)).alias("e")).select("e.*")), rate)
        turned = relations.withColumn("key", F.col("rel").cast("string")).join(turns.select("key", "n", "g"), "key", "left")
        step = F.when(F.col("g").isNull(), F.col("v")).otherwise(F.zip_with("v", "g", lambda x, y: x - rate * y / F.col("n")))
        relations = stored(turned.select("rel", step.alias("v")), "relations")
    return made.state.select("id", "v"), relations
