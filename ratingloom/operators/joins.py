"""Join helpers: settled small sides, null-safe keys, one-row attachments, integrity checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ratingloom.session import shared_folder

# a summary of at most so many rows is sent to every task; counted, not estimated
SUMMARY_ROWS = 100_000


def settled(df: DataFrame) -> DataFrame:
    """A small result that several plans read, computed once and kept as a checkpoint in the shared folder.

    Spark's context cleaner removes the files with the frame, where ``spark.cleaner.referenceTracking.cleanCheckpoints``
    is on; nothing stays persisted on executors.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def join_on_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi-join where null keys match each other; the key columns of ``left`` are kept."""
    renamed = right.withColumnsRenamed({key: f"__right_{key}" for key in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__right_{k}")) for k in keys])
    return left.join(renamed, same, how).drop(*[f"__right_{key}" for key in keys])


def join_summary(left: DataFrame, summary: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """``join_on_keys`` with a summary that is computed and counted first; few rows are broadcast.

    A planner that does not know the size of an aggregate shuffles both sides before it learns that one is small; then all
    rows of ``left`` have moved to a handful of keys. A summary of more than ``SUMMARY_ROWS`` is left to the planner.
    """
    known = settled(summary)
    return join_on_keys(left, F.broadcast(known) if known.count() <= SUMMARY_ROWS else known, keys, how)


def with_one_row(df: DataFrame, one_row: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Attach the columns of a one-row frame to every row; an empty frame leaves no rows.

    The row travels as a scalar subquery, so there is no join; more than one row is an error.
    """
    names = columns or one_row.columns
    row = one_row.select(F.struct(*names).alias("row")).scalar()
    attached = df.withColumn("__row", row).where(F.col("__row").isNotNull())
    return attached.select(*df.columns, *[F.col(f"__row.{name}").alias(name) for name in names])


def latest_only(df: DataFrame, period: str) -> DataFrame:
    """Rows of the latest period; the maximum reaches the scan as a pushed-down filter."""
    latest = df.agg(F.max(period).alias("latest")).scalar()
    return df.where(F.col(period) == latest)


def decode_join(df: DataFrame, lookup: DataFrame, code: str) -> DataFrame:
    """Inner join to a lookup table by code. A lookup of at most ``SUMMARY_ROWS`` is broadcast; the planner does not know the
    size of literal rows and would move all rows of ``df`` to as many tasks as there are codes."""
    return df.join(F.broadcast(lookup) if lookup.count() <= SUMMARY_ROWS else lookup, code, "inner")


def attach_predictions(fact: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """Left join of predictions to facts, unscored facts kept."""
    return fact.join(predictions, key, "left")


def join_eval(predictions: DataFrame, fact: DataFrame, key: str) -> DataFrame:
    """Scored facts only: key-to-key inner join."""
    return predictions.join(fact, key, "inner")


def fk_violations(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str, name: str) -> DataFrame:
    """Child rows and distinct child keys without a parent, one row.

    Child keys are counted before the join, so a hot key is one row on the wire.
    """
    used = child.where(F.col(child_key).isNotNull()).groupBy(child_key).agg(F.count(F.lit(1)).alias("rows"))
    known = parent.select(F.col(parent_key).alias(child_key)).distinct()
    orphans = used.join(known, child_key, "left_anti")
    return orphans.agg(
        F.lit(name).alias("constraint_name"),
        F.count(F.lit(1)).alias("orphan_keys"),
        F.coalesce(F.sum("rows"), F.lit(0)).cast("long").alias("orphan_rows"),
    )


def pk_violations(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Key values held by more than one row and the rows that hold them, one row."""
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    return groups.where(F.col("rows") > 1).agg(
        F.lit(name).alias("constraint_name"),
        F.count(F.lit(1)).alias("repeated_keys"),
        F.coalesce(F.sum("rows"), F.lit(0)).cast("long").alias("repeated_rows"),
    )


def reproduction_diff(stored: DataFrame, rebuilt: DataFrame, key: str, value: str) -> DataFrame:
    """Rows compared and the largest absolute difference between two scorings of the same keys."""
    other = rebuilt.select(key, F.col(value).alias("__other"))
    return stored.select(key, value).join(other, key).agg(
        F.count(F.lit(1)).alias("rows_compared"),
        F.max(F.abs(F.col(value).cast("double") - F.col("__other").cast("double"))).alias("max_difference"),
    )
