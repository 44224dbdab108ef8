"""Shared steps of the operators: reading tables, cutting lineage, joining with a side of a checked size, packing rows."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ratingloom.session import shared_folder

# a side of at most so many rows may be broadcast; counted, not estimated
SMALL_ROWS = 100_000

# white space of the word rules: space, tab, line feed, vertical tab, form feed, carriage return
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def on_workers(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, unless it is installed there anyway."""
    environment, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, root])


def cut(df: DataFrame) -> DataFrame:
    """The rows as a reliable checkpoint in the folder that the cluster shares; later plans start there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def with_small(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join with a side that is broadcast only if its counted rows are few; else both are shuffled on the keys.

    ``small`` should be cut or cheap, since it is counted first. Keys compare null-safely.
    """
    renamed = small.select(*[F.col(c).alias(f"__k_{c}") if c in on else F.col(c) for c in small.columns])
    if renamed.count() <= SMALL_ROWS:
        renamed = F.broadcast(renamed)
    condition = None
    for c in on:
        same = F.col(c).eqNullSafe(F.col(f"__k_{c}"))
        condition = same if condition is None else condition & same
    return big.join(renamed, condition, how).drop(*[f"__k_{c}" for c in on])


def lowered(text: Column) -> Column:
    """A-Z to lower case, every other character as it is."""
    ascii_only = ~text.rlike(r"[^\x00-\x7F]")
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the parts alone."""
    hashed = F.xxhash64(F.lit(seed), *parts)
    return F.pmod(hashed, F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))
