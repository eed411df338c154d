"""A corpus pipeline out of the operators of ``strandline.llm``.

Each stage takes the documents that the one before kept, written as Parquet and read again, and all
but the last return the columns of ``documents``. Rows with a null id pass the stages that judge by
id; rows that repeat an id go together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import decontaminate, language, line_dedup, near_dup, packing
from strandline.llm.common import written


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    return docs.join(gone.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language compression tells clearly; dictionaries come from the labelled documents."""
    model = language.fit(docs, F.lit(True))
    return language.predict(docs, model).where("accepted").select(*docs.columns)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of several documents stay in the first alone; n_chars follows the text."""
    out = line_dedup.dedup_lines(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    return out.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents linked by shingles of five words at a similarity of 0.8, the one of smallest id stays."""
    found = near_dup.find_near_duplicates(docs, words=5, similarity=80)
    return _without(docs, found.where("component_id < doc_id"))


def leaked_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return _without(docs, decontaminate.find_leaks(docs, items, shortest=1))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences, with their ids."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", known_language),
    ("line_dedup", repeated_lines),
    ("near_dedup", near_duplicates),
    ("decontamination", leaked_items),
    ("packing", packed),
]

#: Compression, minhashes, seeds and tokens have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
