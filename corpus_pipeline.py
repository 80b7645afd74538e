"""A corpus pipeline: quality rules, line dedup, near duplicates, mixing, encoding.

Each stage reads what its predecessor kept, as Parquet. All but the last return the
columns of their input; the last returns the ids of each row's tokens.
"""

from __future__ import annotations

import weakref
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import bpe, linetemplates, mixing, neardup, quality
from textloom.llm.columns import WORD
from textloom.plans.workdir import delete_tables, materialize, reads_from, work_tables

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
ORACLE_SQL = None  # byte-pair merges can't be said in SQL


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the base rule and their group's thresholds let pass."""
    rows = docs.select(F.struct("*").alias("row"), "text", "lang", "source")
    judged = materialize(quality.with_verdict_inputs(
        quality.base_figures(rows, keep=["row", "lang", "source"])), "quality-figures")
    return quality.judged(judged, quality.thresholds(judged)).where("kept").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without recurring lines; rows of which no word is left go too."""
    found = linetemplates.dedup_lines(docs)
    left = (F.col("n_dropped") == 0) | F.col("kept_text").rlike(WORD)
    text = F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(F.col("row.text"))
    columns = [text.alias(c) if c == "text"
               else F.when(F.col("n_dropped") > 0, F.length("kept_text")).otherwise(F.col("row.n_chars"))
               .cast(docs.schema[c].dataType).alias(c) if c == "n_chars"
               else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return found.where(left).select(*columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that of its smallest id."""
    return neardup.first_of_groups(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix repeats them."""
    return mixing.repeated(mixing.mixed(docs, mixing.plan_mix(docs)))


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every row."""
    decoded = bpe.round_trip(docs, VOCABULARY)
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


_earlier: list[tuple[weakref.ref, list[str]]] = []


def _staged(stage):
    """A stage that removes the work tables of earlier ones once nothing can read them:
    their result is gone, and the documents that come in are not read from them.

    Work tables back the result that a stage returns, so they stay until it is written.
    """
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for entry in list(_earlier):
            result, made = entry
            if result() is None and not reads_from(docs, made):
                delete_tables(spark, made)
                _earlier.remove(entry)
        with work_tables() as made:
            out = stage(spark, docs, sf_dir)
        _earlier.append((weakref.ref(out), made))
        return out
    return run_stage


STAGES = [(name, _staged(stage)) for name, stage in (
    ("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
    ("mixing", mix_sources), ("bpe", encode_bpe))]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        with work_tables() as written:
            docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        # What the last but one stage left was read for the last time.
        delete_tables(spark, before)
        before = written
    return STAGES[-1][1](spark, docs, sf_dir)
