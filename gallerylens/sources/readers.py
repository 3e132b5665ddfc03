"""Readers; every schema is given, none is inferred."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PAGE = "text string, title string, url string"
FRAGMENT = "id int, title string, text string, url string, wiki_id int, paragraph_id int, images array<struct<caption:string,image:binary,type:string,url:string>>"
MESSAGE = "image_id long, messages array<struct<type:string,content:string,tool_calls:array<struct<name:string,args:map<string,string>>>,doc_idxs:array<long>>>"


def wiki_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages from JSON lines in files wiki* at any depth; lines that are no JSON are dropped."""
    return spark.read.schema(PAGE).option("recursiveFileLookup", True).option("pathGlobFilter", "wiki*").option("mode", "DROPMALFORMED").json(folder)


def csv(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """A table with a header; quoted cells may hold line breaks."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("sep", sep).csv(path)


def triples(spark: SparkSession, path: str) -> DataFrame:
    """(head, rel, tail) from tab-separated lines without a header."""
    return spark.read.schema("head string, rel string, tail string").option("sep", "\t").csv(path)


def graph_split(spark: SparkSession, path: str) -> DataFrame:
    """(artwork, task, label) from one JSON document of nested maps."""
    doc = spark.read.schema("relationships map<string, map<string, array<long>>>").option("multiLine", True).json(path)
    tasks = doc.select(F.explode("relationships").alias("artwork", "tasks")).select("artwork", F.explode("tasks").alias("task", "labels"))
    return tasks.select("artwork", "task", F.explode("labels").alias("label"))


def valid_labels(spark: SparkSession, path: str) -> DataFrame:
    """(task, label) from one JSON document."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, array<long>>").alias("m"))
    return doc.select(F.explode("m").alias("task", "labels")).select("task", F.explode("labels").alias("label"))


def predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MESSAGE).option("multiLine", True).json(path)


def images(spark: SparkSession, folder: str, suffix: str = "*.jpg") -> DataFrame:
    """(path, modificationTime, length, content)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", suffix).load(folder)


def latest_checkpoint(spark: SparkSession, folder: str, prefix: str = "checkpoint-") -> str | None:
    """The path below folder, on any file system that Spark reads, whose name is prefix and the largest number; None without one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    names = [f.getPath().getName() for f in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)]
    numbers = [int(n.removeprefix(prefix)) for n in names if n.startswith(prefix) and n.removeprefix(prefix).isdigit()]
    return f"{folder}/{prefix}{max(numbers)}" if numbers else None


def fetch(urls: DataFrame, get: Callable[[str], bytes | None], url_col: str = "url") -> DataFrame:
    """urls with their content by get, which runs on the executors; a failure gives null content and its message."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for url in pdf[url_col]:
                try:
                    rows.append((url, get(url), None))
                except Exception as error:  # any failure is this row's result
                    rows.append((url, None, str(error)))
            yield pd.DataFrame(rows, columns=["url", "content", "error"])

    return urls.select(url_col).mapInPandas(run, "url string, content binary, error string")


class Paged(DataSource):
    """Rows of an API that answers with a page and a token for the next one.

    Register a subclass whose fetch(category, token) returns (rows, next token or None); option categories
    lists what to ask for, each a partition of its own.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "category string, id long, title string"

    @staticmethod
    def fetch(category: str, token: str | None) -> tuple[list[tuple[int, str]], str | None]:
        raise NotImplementedError("a subclass asks the API")

    def reader(self, schema) -> DataSourceReader:
        return _PagedReader(self.options.get("categories", ""), type(self).fetch)


class _PagedReader(DataSourceReader):
    def __init__(self, categories: str, fetch) -> None:
        self.categories, self.fetch = [c for c in categories.split("|") if c], fetch

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(c) for c in self.categories]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        token = None
        while True:
            rows, token = self.fetch(partition.value, token)
            for i, title in rows:
                yield partition.value, i, title
            if token is None:
                return
