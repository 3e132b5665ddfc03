"""An index of multi-vector documents by lists, so that MaxSim reads only the lists near a query's tokens.

Every token vector lies in the list of its nearest centre, as planes of sign bits of what the centre leaves.  There are
about as many lists as the square root of all vectors: cells are fitted on a bounded sample, and in each cell, by a
task of its own, lists on a bounded sample of the cell's vectors.  A search scores the lists near each query token,
takes the best documents by what it has seen (a token of which a document shows nothing counts as the first list that
was not read), and scores these by their vectors.  How many lists a query token reads is measured on a sample of
documents, for a stated recall; every document is indexed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .index import _unit, centres
from .quantised import SAMPLE_DOCUMENTS, SAMPLE_QUERIES, SAMPLE_VALUES, decode, encode, rescored
from .retrieval import TILE, Best, _matrix, _query_blocks, maxsim_topk, query_tiles, rank
from .scratch import stored

#: Vectors from which cells are fitted, vectors for each list of a cell and in all, values of all centres, tasks that write a cell.
CELL_SAMPLE, LIST_SAMPLE, CELL_ROWS, CENTRE_VALUES, SPREAD = 20_000, 32, 20_000, 64 << 20, 8
#: Vectors of documents whose lists are looked at together.
SEEN = 4096
#: Below so many documents a scan is as good.
THRESHOLD = 20_000


@dataclass
class MultiIndex:
    path: str
    centres: np.ndarray  # lists by dimensions
    cell: np.ndarray  # of each list
    planes: int
    probes: int

    def rows(self, spark: SparkSession) -> DataFrame:
        """(list, id, bits, scales, cell): a row for each vector, a folder for each cell."""
        return spark.read.schema("list int, id long, bits binary, scales binary, cell int").parquet(self.path)

    def status(self, documents: DataFrame) -> tuple[int, int]:
        """Documents with vectors that are indexed, and all of them: equal once the index is complete."""
        ids = documents.where(F.size("vs") > 0).select(F.col("id").cast("long").alias("id")).distinct()
        return ids.join(self.rows(documents.sparkSession).select("id").distinct(), "id", "left_semi").count(), ids.count()


def _vectors(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("id").cast("long").alias("id"), F.posexplode(F.col("vs").cast("array<array<double>>")).alias("tok", "v"))


def _nearest(v: np.ndarray, found: np.ndarray, cells: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """The list of each vector: the nearest cell, then the nearest list in it."""
    unit = _unit(v)
    own = (unit @ cells.T).argmax(axis=1)
    out = np.zeros(len(v), np.int64)
    for c in np.unique(own).tolist():
        lists, rows = np.flatnonzero(cell == c), np.flatnonzero(own == c)
        out[rows] = lists[(unit[rows] @ _unit(found[lists]).T).argmax(axis=1)]
    return out


def _cells(found: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """The direction of each cell: that of its lists' mean."""
    sums = np.zeros((int(cell.max()) + 1 if len(cell) else 0, found.shape[1]))
    np.add.at(sums, cell, _unit(found))
    return _unit(sums)


def fit(documents: DataFrame, lists: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(centres, cell of each): about the square root of all vectors as lists."""
    vectors = _vectors(documents)
    total, dim = vectors.agg(F.count("*"), F.max(F.size("v"))).first()
    if not total:
        return np.zeros((0, 0)), np.zeros(0, np.int64)
    wanted = max(1, min(lists or round(total**0.5), CENTRE_VALUES // dim))
    by_hash = F.xxhash64("id", "tok")
    first = vectors.orderBy(by_hash, "id", "tok").limit(CELL_SAMPLE).select("v").toPandas()["v"]  # bounded
    cells = centres(np.array(first.tolist(), np.float64), max(1, round(wanted**0.5)))
    shared = vectors.sparkSession.sparkContext.broadcast(cells)
    each = math.ceil(wanted / len(cells))
    every = max(1, total // (wanted * LIST_SAMPLE))  # a sample that grows with the lists

    def place(batches):
        for batch in batches:
            own = (_unit(_matrix(batch.column("v"))) @ shared.value.T).argmax(axis=1) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), batch.column("h"), batch.column("v")], ["cell", "h", "v"])

    some = vectors.withColumn("h", by_hash).where(F.pmod("h", F.lit(every)) == 0).select("h", "v").mapInArrow(place, "cell int, h long, v array<double>")
    some = some.withColumn("r", F.row_number().over(Window.partitionBy("cell").orderBy("h"))).where(F.col("r") <= CELL_ROWS).select("cell", "v")

    def split(key, table):
        made = centres(_matrix(table.column("v").combine_chunks()), each)
        return pa.table([pa.array(np.full(len(made), key[0].as_py(), np.int32)), pa.array(made.tolist(), pa.list_(pa.float64()))], ["cell", "c"])

    rows = some.groupBy("cell").applyInArrow(split, "cell int, c array<double>").orderBy("cell", "c").collect()  # CENTRE_VALUES at most
    if not rows:
        return cells, np.arange(len(cells))
    return np.array([r[1] for r in rows]), np.array([r[0] for r in rows], np.int64)


def _write(index: MultiIndex, documents: DataFrame, mode: str) -> None:
    shared = documents.sparkSession.sparkContext.broadcast((index.centres, index.cell, np.unique(index.cell, return_inverse=True)[1]))
    planes = index.planes

    def assign(batches):
        found, cell, dense = shared.value
        cells = _cells(found, dense)
        for batch in batches:
            if not batch.num_rows or not len(found):
                continue
            v = _matrix(batch.column("v"))
            own = _nearest(v, found, cells, dense)
            bits, scales = encode(v - found[own], planes)
            columns = [pa.array(own.astype(np.int32)), batch.column("id"), pa.array([x.tobytes() for x in bits], pa.binary()), pa.array([x.tobytes() for x in scales], pa.binary()), pa.array(cell[own].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["list", "id", "bits", "scales", "cell"])

    placed = _vectors(documents).select("id", "v").mapInArrow(assign, "list int, id long, bits binary, scales binary, cell int")
    # a cell that holds many of all vectors is written by several tasks
    placed.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(SPREAD))).sortWithinPartitions("cell", "list").write.mode(mode).partitionBy("cell").parquet(index.path)


def build(documents: DataFrame, path: str, recall: float = 0.95, k: int = 10, prefetch: int = 100, planes: int | None = None, lists: int | None = None) -> MultiIndex:
    """The index of documents (id, vs), at path; documents without vectors are in no list, and an empty table has no list.

    As many planes of bits, 2 to 6, as the recall needs if half of the lists are read at most, where none are given.
    """
    found, cell = fit(documents, lists)
    made = MultiIndex(path, found, cell, planes or 2, 1)
    held, taken = sampled(documents, k, prefetch)
    made.probes = measure(made, held, taken, recall, k)
    while planes is None and made.planes < 6 and made.probes > len(found) / 2:
        finer = MultiIndex(path, found, cell, made.planes + 1, 1)
        finer.probes = measure(finer, held, taken, recall, k)
        if finer.probes == made.probes < len(found):  # more bits help no further
            break
        made = finer
    _write(made, documents, "overwrite")
    return made


def add(index: MultiIndex, documents: DataFrame) -> None:
    """Documents that have come since are put into the same lists."""
    _write(index, documents, "append")


def build_if_large(documents: DataFrame, path: str, threshold: int = THRESHOLD, **settings) -> MultiIndex | None:
    """No index below the threshold of documents: `search` then scans."""
    return build(documents, path, **settings) if documents.limit(threshold).count() >= threshold else None


def sampled(documents: DataFrame, k: int, prefetch: int) -> tuple[list[np.ndarray], int]:
    """The vectors of a bounded sample of documents, and how many of these prefetch is the same share of, k at least."""
    n = documents.count()
    size = documents.agg(F.avg(F.size("vs") * F.size(F.get("vs", F.lit(0))))).first()[0] or 1
    sample = documents.where(F.size("vs") > 0).orderBy(F.xxhash64("id"), "id").limit(max(20, min(SAMPLE_DOCUMENTS, int(SAMPLE_VALUES / size)))).select("vs").toPandas()["vs"]  # bounded
    held = [np.array([list(v) for v in vs], np.float64) for vs in sample]
    return held, min(len(held), max(k, round(prefetch / max(n, 1) * len(held))))


def measure(index: MultiIndex, held: list[np.ndarray], taken: int, recall: float, k: int) -> int:
    """The least number of lists a query token has to read (1, 2, 3, 4, 5, 8, ... of all) so that the documents taken hold so much of the k best ones, by a sample."""
    if len(held) < 2:
        return 1
    edges = np.concatenate([[0], np.cumsum([len(d) for d in held])])
    flat, asked = np.concatenate(held), min(SAMPLE_QUERIES, len(held))
    q, first = flat[: edges[asked]], edges[:asked]
    maxsim = lambda x: np.add.reduceat(np.maximum.reduceat(x, edges[:-1], axis=1), first, axis=0)
    best = np.argsort(-maxsim(q @ flat.T), axis=1, kind="stable")[:, :k]
    dense = np.unique(index.cell, return_inverse=True)[1]
    own = _nearest(flat, index.centres, _cells(index.centres, dense), dense)
    near = q @ (index.centres[own] + decode(*encode(flat - index.centres[own], index.planes), flat.shape[1])).T
    scores = q @ index.centres.T
    order = np.argsort(-scores, axis=1, kind="stable")
    place = np.argsort(order, axis=1, kind="stable")[:, own]
    tried, probes = 1, 1
    while probes < len(index.centres):
        seen = np.where(place < probes, near, np.take_along_axis(scores, order[:, [probes]], axis=1))
        rows = np.argsort(np.argsort(-maxsim(seen), axis=1, kind="stable"), axis=1, kind="stable")
        if (np.take_along_axis(rows, best, axis=1) < taken).mean() >= recall:
            return probes
        tried += 1
        probes = tried if tried < 4 else int(4 * 2 ** ((tried - 4) / 2))
    return len(index.centres)


def search(index: MultiIndex | None, queries: DataFrame, documents: DataFrame, k: int = 10, prefetch: int = 100, probes: int | None = None) -> DataFrame:
    """(qid, id, score, rank): for each query (qid, qtok, q) the k best of prefetch documents that the lists near its tokens show, by exact MaxSim.

    Queries, a bounded set, are taken in blocks; only the cells of the lists that a block asks for are read.  Without
    an index all documents are scored.
    """
    if index is None:
        return maxsim_topk(queries, documents, k)
    spark, out = documents.sparkSession, None
    probes = min(probes or index.probes, len(index.centres))
    for qids, q, first in _query_blocks(queries) if len(index.centres) else ():
        asks, floor = np.zeros((len(index.centres), len(q)), bool), np.full(len(q), -np.inf)
        for at in range(0, len(q), TILE):
            scores = q[at : at + TILE] @ index.centres.T
            order = np.argsort(-scores, axis=1, kind="stable")
            asks[order[:, :probes].T, np.arange(at, at + len(scores))] = True
            if probes < len(index.centres):
                floor[at : at + TILE] = np.take_along_axis(scores, order[:, [probes]], axis=1)[:, 0]
        wanted = np.flatnonzero(asks.any(axis=1))
        shared = spark.sparkContext.broadcast((qids, q, first, floor, np.packbits(asks, axis=1), {int(n): index.centres[n] for n in wanted}))
        planes = index.planes

        def look(batches, shared=shared):
            qids, q, first, floor, asks, found = shared.value
            tiles, ends, best = list(query_tiles(first, len(q), TILE)), np.append(first, len(q)), Best(len(qids), prefetch)
            words = -(-q.shape[1] // 64)
            for batch in batches:
                ids, edges = batch.column("id").to_numpy(), batch.column("list").offsets.to_numpy()
                for (d, e), _ in query_tiles(edges[:-1] - edges[0], int(edges[-1] - edges[0]), SEEN):
                    own = batch.slice(d, e - d)
                    of = own.column("list").flatten().to_numpy()
                    bits = np.frombuffer(b"".join(own.column("bits").flatten().to_pylist()), np.uint64).reshape(-1, planes, words)
                    scales = np.frombuffer(b"".join(own.column("scales").flatten().to_pylist()), np.float32).reshape(-1, planes)
                    by_list, starts = np.argsort(of, kind="stable"), edges[d:e] - edges[d]
                    cuts = np.append(np.flatnonzero(np.diff(of[by_list], prepend=-1)), len(of))
                    lists = [(int(of[by_list[x]]), x, y) for x, y in zip(cuts, cuts[1:], strict=False)]
                    v = np.concatenate([found[n] + decode(bits[by_list[x:y]], scales[by_list[x:y]], q.shape[1]) for n, x, y in lists])
                    back = np.argsort(by_list, kind="stable")
                    for (a, b), (r, t) in tiles:
                        asked = np.unpackbits(asks[:, r // 8 : -(-t // 8)], axis=1)[:, r % 8 : r % 8 + t - r].astype(bool)
                        seen = np.full((len(of), t - r), -np.inf)
                        for n, x, y in lists:
                            some = np.flatnonzero(asked[n])
                            seen[x:y, some] = v[x:y] @ q[r:t][some].T
                        shown = np.maximum.reduceat(seen[back], starts, axis=0)
                        # what a document does not show counts as the floor, the same for all: only what is above it tells documents apart
                        above = np.where(np.isinf(floor[r:t]), shown, np.maximum(shown - np.where(np.isinf(floor[r:t]), 0, floor[r:t]), 0))
                        begin = ends[a:b] - r
                        per_query = np.add.reduceat(above, begin, axis=1)
                        per_query[np.maximum.reduceat(shown, begin, axis=1) == -np.inf] = -np.inf  # not seen at all
                        best.add(a, per_query.T, ids[d:e])
            yield from best.batches(qids)

        cells = np.unique(index.cell[wanted]).tolist()
        read = index.rows(spark).where(F.col("cell").isin(cells) & F.col("list").isin(wanted.tolist())).select("list", "id", "bits", "scales")
        # a document's vectors meet in one task, which keeps its best documents a query: no row for a query and a document
        gathered = read.groupBy("id").agg(F.collect_list(F.struct("list", "bits", "scales")).alias("x")).select("id", *(F.col(f"x.{c}").alias(c) for c in ("list", "bits", "scales")))
        summed = gathered.mapInArrow(look, "qid long, id long, score double")
        chosen = stored(rank(summed, "qid", "score", "id", prefetch).select("qid", "id"), "chosen")
        found = rescored(chosen, queries, documents)
        out = found if out is None else out.unionAll(found)
    if out is None:
        return spark.createDataFrame([], "qid long, id long, score double, rank int")
    return rank(out, "qid", "score", "id", k)
