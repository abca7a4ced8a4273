"""The corpus pipeline: documents to packed training sequences.

``STAGES`` are applied in order; each works on all rows its predecessor kept and
is written before the next one reads it, so nothing is computed twice and a lost
executor costs only its tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefmine.llm import mixing, packing, pii, quality, simhash
from prefmine.llm.common import Scratch, free_name
from prefmine.llm.queries import pii_key, read

# Some stages keep state and learn nothing SQL can express (fingerprints, Feistel
# networks, bins); run() is tested against brute force instead.
ORACLE_SQL = None


def _with_text(docs: DataFrame, text) -> DataFrame:
    """``docs`` with a new text and, where there is one, the length that goes with it."""
    out = docs.withColumn("text", text)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines are removed; rejected documents go.  The verdict's columns are
    kept apart, so columns of the same names in ``docs`` stay as they are."""
    whole = docs.select(F.struct(*docs.columns).alias("doc"), "text")
    judged = quality.line_first_quality(whole, clean="clean").where("kept")
    rest = free_name(docs.columns, "clean_")
    return _with_text(judged.select("doc.*", F.col("clean").alias(rest)), F.col(rest)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays: the smallest id."""
    return simhash.one_of_each(docs, k=2, shingle=3).select(*docs.columns)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes pseudonyms of the same format."""
    done = pii.pseudonymise(docs, pii_key(spark))
    return _with_text(done, F.col("text")).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, as often as their source's target takes them.  The
    columns stay those of ``docs``; the order goes on as that of the written rows."""
    return mixing.mix(docs).select(*docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents packed into sequences; bin ids ascend along the training order."""
    return packing.pack(docs, order=mixing.written_order(docs))


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_dedup),
    ("pseudonyms", pseudonyms),
    ("mixing to target weights", mixture),
    ("best-fit packing", sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents in ``sf_dir``; returns the last one's rows."""
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir))
    return docs
