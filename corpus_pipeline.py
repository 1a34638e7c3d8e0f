"""A corpus pipeline over ``documents``: language, lines, near copies, mix, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it is written
as Parquet in the cluster's shared folder and read again as the next stage's
``docs``. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itcflow.llm.common import materialize, table
from itcflow.llm.hyper_lang import UNKNOWN, identify, learn_from_documents
from itcflow.llm.line_dedup import BLANK, dedup_rows
from itcflow.llm.mixing import mixed, mixing_plan
from itcflow.llm.near_dups import drop_near_duplicates
from itcflow.llm.packing import pack


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that have a language; null texts and texts without a letter go.

    As soon as one language is learned this equals a letter test: the score doesn't
    decide, and a text in a language that was not learned stays. Where no document
    has a language to learn, all go."""
    return identify(docs, learn_from_documents(docs)).where(F.col("lang_pred") != UNKNOWN).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated three-line windows; documents of which nothing is left go."""
    left = dedup_rows(docs)
    return left.where(F.btrim("text", F.lit(BLANK)) != "").withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate class."""
    return drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix of sources takes it."""
    return mixed(docs, mixing_plan(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of training sequences."""
    return pack(docs)


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("mix", mix), ("packing", packing)]

#: SQL can't express four of the stages; ``tests/llm`` holds each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: one row a packed piece."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
