"""What the operators share: the shared scratch folder and Arrow helpers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

#: The bytes 0x20 and 0x09-0x0D, which ``bytes.split()`` takes as white space too.
WHITE = b" \t\n\x0b\x0c\r"


def checkpoint_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; a temporary one only where that is unset and all run on this machine."""
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return held.get()


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts lineage, survives lost executors. What was shuffled to make it is freed."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_FREE, "false")
    spark.conf.set(_FREE, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_FREE, before)
    _WRITTEN.paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Whether Spark deletes the shuffle files of an execution at its end, and not when the driver's garbage is collected.
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class _Written(threading.local):
    """What `stored` has written in this thread and nothing has deleted, in order."""

    def __init__(self) -> None:
        self.paths: list[str] = []


_WRITTEN = _Written()


def written() -> int:
    """A mark for `discard`."""
    return len(_WRITTEN.paths)


def discard(spark: SparkSession, since: int) -> None:
    """Deletes what was stored since the mark but for the last: what a result that is stored itself was made from."""
    for path in _WRITTEN.paths[since:-1]:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    del _WRITTEN.paths[since:-1]


_BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1_000
#: Columns that name a row of a file.
ROW = ["__file", "__row"]


def keyed(docs: DataFrame) -> DataFrame:
    """docs with the columns ROW, which name each row for good, whatever its other columns hold: its file and its place there.

    What is not read from Parquet files as it is gets written to the shared folder first.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    row = [F.xxhash64("_metadata.file_path").alias(ROW[0]), F.col("_metadata.row_index").alias(ROW[1])]
    try:
        return docs.select(*columns, *row)
    except AnalysisException:
        return stored(docs, "rows").select(*columns, *row)


def _small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS rows where the session has the usual 10,000, which are sized for short values: a worker and its JVM hold several copies of a batch of texts."""
    if spark.conf.get(_BATCH, "10000") == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """The columns (doc_id long, text string), and those of carry, alone, null texts as empty; other columns cannot clash. A row whose id is null or no number stays, with a null doc_id."""
    _small_batches(docs.sparkSession)
    return docs.select(F.expr(f"try_cast(`{id_col}` AS bigint)").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *carry)


def raw(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8 bytes, without decoding it."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def strings(column: pa.Array) -> list[str]:
    """A string column as text; bytes that are not UTF-8 count as U+FFFD."""
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        return [t.decode("utf-8", "replace") for t in raw(column)]


_KEPT: dict[tuple, object] = {}


def kept(key: tuple, make: Callable[[], object]) -> object:
    """What make gives, kept by a Python worker between tasks; another operator's key takes its place, so that a worker holds one operator's tables at a time."""
    if key not in _KEPT:
        _KEPT.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # another C library keeps what is free
            ctypes.CDLL(None).malloc_trim(0)
        _KEPT[key] = make()
    return _KEPT[key]


def release() -> None:
    """Gives memory that is free back to the machine: a worker lives on, idle, beside those of other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def groups(found: list[bytes], most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most so many bytes together, or of a single text."""
    at, size = 0, 0
    for k, text in enumerate(found):
        if k > at and size + len(text) > most:
            yield at, k
            at, size = k, 0
        size += len(text)
    if at < len(found):
        yield at, len(found)


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """The rows of the named columns, one batch in memory at a time."""
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names), strict=True)


def batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of at most size rows."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
