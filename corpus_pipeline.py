"""A corpus pipeline: toxic documents go, near copies and repeated passages go, secrets are masked, the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it as Parquet to the shared folder and reads it again for the next one.  All
stages but the last return the columns of ``documents``, whatever extra
columns there are and however they are named.  An empty table passes every
stage as one; rows that repeat a doc_id or a text are handled as the operators
state; texts are read whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fahrwerk.llm.common import free_names, materialize
from fahrwerk.llm.ngram_join import BROADCAST_ROWS, jaccard_components
from fahrwerk.llm.packing import pack_documents
from fahrwerk.llm.secret_scan import redact
from fahrwerk.llm.substring_dedup import drop_repeats
from fahrwerk.llm.toxicity import drop_toxic

#: Labels learned from, at most; stated in the README.
LABELLED_LIMIT = 20_000


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't score as toxic; null and empty texts stay.  Tables without labels leave the lexicon to decide."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), LABELLED_LIMIT)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id; rows that repeat it stay, as do rows without text or doc_id."""
    groups = jaccard_components(docs)
    (key,) = free_names(docs, "key")
    others = materialize(groups.where("doc_id <> component_id").select(F.col("doc_id").alias(key)).distinct())
    near = F.broadcast(others) if others.count() <= BROADCAST_ROWS else others
    return docs.join(near, docs["doc_id"] == F.col(key), "left_anti").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one holds; those of which nothing remains go, null and empty texts stay."""
    return drop_repeats(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with secrets masked; null and empty texts stay as they are."""
    out = redact(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids, packed into sequences; null and empty texts are their end id alone."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_copies", near_copies),
    ("repeated_passages", repeated_passages),
    ("secrets", secrets),
    ("packing", packing),
]

#: SQL can't express the classifier nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES) and not hasattr(docs, "_llm_path"):  # some stages have written theirs
            docs = materialize(docs)
    return docs
