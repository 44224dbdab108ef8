"""Exact quantiles with linear interpolation, from counted distinct values.

Rows are first counted per (group, value), with partial counts before the shuffle, so a hot group
spreads over its values. The counted table answers every quantile, bound and moment that is asked of it. Distinct values
are never sorted as a whole: counts by steps of a group's range narrow each quantile down to a part that is small enough.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ratingloom.operators.joins import join_on_keys, join_summary
from ratingloom.session import stored

ROWS = "rows"
# distinct values that one task puts in order, and steps into which a larger part is cut
AT_ONCE = 65_536
CUTS = 1_024
_PART = "__part"


def value_counts(df: DataFrame, value: str, keys: list[str] | tuple = ()) -> DataFrame:
    """(keys, value, rows) over known values; NaN is not a known value."""
    known = F.col(value).isNotNull()
    if dict(df.dtypes)[value] in ("double", "float"):
        known = known & ~F.isnan(value)
    return df.where(known).groupBy(*keys, value).agg(F.count(F.lit(1)).alias(ROWS))


def _rank(p: float) -> Column:
    """Place of a quantile among the ``__total`` known values, counted from 0."""
    return (F.col("__total") - 1) * F.lit(float(p))


def _near_ranks(counts: DataFrame, value: str, probs: dict[str, float], keys: list[str]) -> DataFrame:
    """(keys, __number, rows, __part, __total): the values around the wanted ranks, in parts of at most ``AT_ONCE`` values.

    ``__part`` is the number of known values below a part, so it also names the part; a group starts as one part. A part
    of more values is cut into ``CUTS`` even steps between its ends, the rows of each step are counted, and only steps
    that hold a wanted rank go on, as parts of their own. Infinite values are steps of their own. A pass keeps at most
    two steps for each quantile, and both ends of a part fall into different steps, so every part comes to an end.
    """
    number = F.col("__number")
    finite = F.when(F.abs(number) < float("inf"), number)
    ends = [F.count(F.lit(1)).alias("__values"), F.min(finite).alias("__low"), F.max(finite).alias("__high")]
    parts = counts.select(*keys, F.col(value).cast("double").alias("__number"), ROWS)
    sizes = parts.groupBy(*keys).agg(F.sum(ROWS).alias("__total"), *ends)
    if keys:
        parts = join_summary(parts, sizes, keys)
    else:
        whole = sizes.select(F.struct(*sizes.columns).alias("whole")).scalar()
        parts = parts.withColumn("__whole", whole).select(*parts.columns, "__whole.*")
    parts = parts.withColumn(_PART, F.lit(0).cast("long"))
    while True:
        # halves, because the width of a part may exceed the largest double
        width = F.nullif(F.col("__high") / 2 - F.col("__low") / 2, F.lit(0.0))
        step = F.coalesce(F.floor((number / 2 - F.col("__low") / 2) / width * CUTS), F.lit(0)).cast("int")
        step = F.when(number == float("-inf"), -1).when(number == float("inf"), CUTS + 1).otherwise(step)
        cut = parts.select(*keys, "__number", ROWS, _PART, "__total", step.alias("__step"))
        steps = cut.groupBy(*keys, _PART, "__step").agg(F.sum(ROWS).alias("__rows"), F.first("__total").alias("__total"), *ends)
        # at most CUTS + 3 steps of a part
        earlier = Window.partitionBy(*keys, _PART).orderBy("__step").rowsBetween(Window.unboundedPreceding, -1)
        below = steps.withColumn("__below", F.col(_PART) + F.coalesce(F.sum("__rows").over(earlier), F.lit(0)))
        ranks = [edge(_rank(p)) for p in probs.values() for edge in (F.floor, F.ceil)]
        held = [(rank >= F.col("__below")) & (rank < F.col("__below") + F.col("__rows")) for rank in ranks]
        kept = stored(below.where(reduce(lambda a, b: a | b, held)).drop("__rows", "__total"), "steps")
        inside = join_on_keys(cut, kept, [*keys, _PART, "__step"], "inner").drop(_PART, "__step")
        parts = inside.withColumnRenamed("__below", _PART)
        if (kept.agg(F.max("__values")).first()[0] or 0) <= AT_ONCE:
            return parts.select(*keys, "__number", ROWS, _PART, "__total")
        # distinct numbers of other types may be one double
        merged = parts.groupBy(*keys, "__number", _PART, "__total", "__low", "__high").agg(F.sum(ROWS).alias(ROWS))
        parts = stored(merged, "near-ranks")


def quantiles_of_counts(
    counts: DataFrame,
    value: str,
    probs: dict[str, float],
    keys: list[str] | tuple = (),
) -> DataFrame:
    """One row per group with an interpolated quantile per entry of ``probs``.

    ``counts`` is read more than once, so it should be a stored frame."""
    keys = list(keys)
    near = _near_ranks(counts, value, probs, keys)
    upto = Window.partitionBy(*keys, _PART).orderBy("__number").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sized = near.withColumn("__running", F.col(_PART) + F.sum(ROWS).over(upto))
    number = F.col("__number")
    picks = [
        F.min(F.when(F.col("__running") > edge(_rank(p)), number)).alias(f"__{side}_{name}")
        for name, p in probs.items()
        for side, edge in (("low", F.floor), ("high", F.ceil))
    ]
    picked = sized.groupBy(*keys).agg(F.first("__total").alias("__total"), *picks)
    return picked.select(
        *keys,
        *[
            (
                F.col(f"__low_{name}")
                + (F.col(f"__high_{name}") - F.col(f"__low_{name}")) * (_rank(p) - F.floor(_rank(p)))
            ).alias(name)
            for name, p in probs.items()
        ],
    )


def grouped_quantiles(
    df: DataFrame,
    value: str,
    probs: dict[str, float],
    keys: list[str] | tuple = (),
) -> DataFrame:
    """Exact interpolated quantiles of ``value`` per group; groups without a known value are absent.

    The counts are stored before they are ranked, so the rows are read once."""
    return quantiles_of_counts(stored(value_counts(df, value, keys), "value-counts"), value, probs, keys)
