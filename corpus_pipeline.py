"""From raw documents to packed sequences, in stages that are each written and read again.

Each stage works on all rows its predecessor kept, and judges each row for itself: rows that share a doc_id, or
have none, are told apart by their place in the files they are read from.  All but the last return the columns of
documents.  In every stage an empty table gives an empty result, and columns of other names pass.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from gallerylens.llm import common, exact, packing, secret_scan, shingles, toxicity

#: So many rows of 16 bytes at most are broadcast.
BROADCAST_ROWS = 500_000


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents predicted toxic; the model is trained on the labelled documents of sf_dir.

    Null and empty texts hold no expression that speaks for toxic and stay, as do repeated rows of a text that stays.
    """
    model = toxicity.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_ordinary(docs, model)


def _kept(rows: DataFrame, judged: DataFrame) -> DataFrame:
    """The rows (with the columns that name them) that are kept in judged: without those that are not, which are broadcast if they are counted to be few."""
    dropped = common.stored(judged.where("not kept").select(*common.ROW), "dropped")
    few = dropped.count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(dropped) if few else dropped, common.ROW, "left_anti").drop(*common.ROW)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of equal texts stays: of the most code points, then the smallest doc_id, a null one being the largest.

    Of several such rows, as of repeated ones, one stays.  Null, empty and white texts are one class.
    """
    rows = common.keyed(docs)
    return _kept(rows, exact.exact_dedup(rows, carry=common.ROW))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of texts whose 5-word shingles have a Jaccard similarity of 0.8 or more stays: of the smallest doc_id, a null one being the largest.

    Of several rows of that doc_id one stays.  Texts without a word are equal to each other alone.
    """
    rows = common.keyed(docs)
    return _kept(rows, shingles.similar_documents(rows, words=5, similarity=0.8, carry=common.ROW))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays; secrets found in its text are replaced by a mark and n_chars follows. Rows without any are unchanged, null texts too."""
    return secret_scan.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences; a null or empty text is one piece of the end id, and repeated rows are packed each for itself."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity_stage), ("exact dedup", exact_stage), ("simhash near-dedup", near_stage), ("secret scans", secrets_stage), ("best-fit packing", packing_stage)]
#: The language models, the shingles and the tokenizer have no counterpart in SQL; tests/llm holds a brute-force version of every stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, one after the other; what a stage has stored goes once its result is."""
    docs, mark = spark.read.parquet(f"{sf_dir}/documents.parquet"), common.written()
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        common.discard(spark, mark)
    return STAGES[-1][1](spark, docs, sf_dir)
