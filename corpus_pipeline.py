"""From raw documents to packed training sequences: quality rules, toxicity, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last return the columns
of documents. A stage's result is written as Parquet in the shared folder and read again, so that no stage is computed
twice and lost executors cost only the stage that runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsengine.llm import packing, quality, simhash, toxicity
from tsengine.llm.common import free_name, materialise, table

#: SQL can't express the learned stages; the tests compare the result with a plain version of it.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the rules' posterior keep."""
    return quality.keep(docs, "text")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under the threshold; the labels of those that are left are learned from."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    name = free_name(docs, "toxicity")
    return toxicity.score(docs, "text", model, name).filter(F.col(name) < toxicity.THRESHOLD).drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the smallest id (of equal ids, one row)."""
    return simhash.keep_one(docs, "doc_id", "text")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document, with its sequence and offset."""
    return packing.pack_documents(docs, "doc_id", "text", packing.word_tokenizer())


STAGES = [("quality", quality_rules), ("toxicity", toxic), ("near_duplicates", near_duplicates), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
