"""A training corpus from raw documents in five stages, each written and read again by the next.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last keep the columns of ``documents``. A stage works
on everything its predecessor kept. Toxicity learns from the labels beside the documents, decontamination reads the
benchmark there, and mixing, the last stage, returns how often each document is taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ratingloom.llm import decontam, line_templates, mixing, near_dups, toxicity
from ratingloom.llm.store import table
from ratingloom.session import stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity machine rejects go."""
    learned = toxicity.learned_from(F.col("doc_id"))
    machine = toxicity.train(docs.where(learned), table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, machine)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of templates that recur across documents go; every document stays, ``n_chars`` counts what is left of it."""
    kept = line_templates.drop_recurring_lines(docs)
    changed = F.col("n_dropped") > 0
    left = F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", left).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id, and that as one row."""
    return near_dups.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document."""
    return mixing.mix_sources(docs).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("near dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
]

# a trained machine and drawn roundings have no SQL; stages are tested against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
