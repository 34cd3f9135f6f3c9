"""From documents to packed token sequences: five stages, each written as Parquet and read by the next.

``run(spark, sf_dir)`` applies them to ``documents``.  Every stage takes (spark, docs, sf_dir); all but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from maskwright.llm import common, decontaminate, packing, quality, simhash, substrings
from maskwright.llm.queries import remainder

#: Needs a classifier and a tokenizer, which SQL has not; tested against a brute-force version.
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the rule ensemble rejects; it learns as ``op7`` does, from this stage's documents."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.learn(docs, labels, remainder("_label_key", 5) != 0)
    return quality.accepted(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies: that with the smallest id, as ``simhash.keep_first`` orders them."""
    return simhash.keep_first(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages out that an earlier document holds; every document stays, with what is left of its text."""
    removed = "_".join(["removed", *docs.columns])  # a name that no column has
    return substrings.cut_documents(docs, removed=removed).withColumn(
        "n_chars", F.when(F.col(removed) > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    ).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that overlap with a benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: a row for each piece of a document, as ``op3`` gives it."""
    return packing.pack_documents(docs, "word_bpe_49k.json", 2)


STAGES = [
    ("quality classifier", keep_good),
    ("SimHash near-dedup", drop_near_copies),
    ("substring dedup", cut_repeats),
    ("benchmark decontamination", drop_leaks),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), name.split()[0].lower())
    return docs
