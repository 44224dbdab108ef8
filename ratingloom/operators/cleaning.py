"""Duplicate removal, canonical text and categories, derived columns, and the whole cleaning job."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ratingloom.functions.numeric import bucketize, flag, half_even, period_label, safe_ratio
from ratingloom.functions.text import (
    category_key,
    decode,
    decode_or_raise,
    leading_letters,
    normalize_text,
    strip,
    trailing_number,
)
from ratingloom.operators.benchmarks import peer_benchmark
from ratingloom.operators.joins import SUMMARY_ROWS
from ratingloom.operators.ordering import dense_key
from ratingloom.session import leave_wide_stages_unfused, stored
from ratingloom.sources import schema as S
from ratingloom.sources.readers import check_header, rename

_DIGEST = "__digest"


def first_of_copies(df: DataFrame, columns: list[str], order: str) -> DataFrame:
    """The smallest ``order`` value and the number of rows of every distinct combination of ``columns``.

    Counts and minima combine before the shuffle, so a group of copies travels as one row per task.
    """
    return df.groupBy(*columns).agg(F.min(order).alias(order), F.count(F.lit(1)).alias("copies"))


def firsts_by_digest(df: DataFrame, columns: list[str], order: str) -> DataFrame:
    """``columns`` and smallest ``order`` of every distinct combination of ``columns``.

    Equal rows have equal digests, so rows whose digest stands alone are no copies and stay where they are; only the others
    are grouped by all their columns. If many digests recur, all rows are.
    """
    digest = F.xxhash64(*columns).alias(_DIGEST)
    recurring = df.select(digest).groupBy(_DIGEST).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)
    recurring = stored(recurring.select(_DIGEST), "recurring-digests")
    if recurring.count() > SUMMARY_ROWS:
        return first_of_copies(df, columns, order).drop("copies")
    digested = df.select(*columns, order, digest)
    alone = digested.join(F.broadcast(recurring), _DIGEST, "left_anti").drop(_DIGEST)
    copies = digested.join(F.broadcast(recurring), _DIGEST, "left_semi").drop(_DIGEST)
    return alone.unionByName(first_of_copies(copies, columns, order).drop("copies"))


def split_exact_duplicates(df: DataFrame, columns: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): the first row by the unique ``order`` of each set of equal rows, and the rest.

    Nulls are equal to each other, and text is compared exactly as it stands.
    """
    firsts = firsts_by_digest(df, columns, order)
    removed = df.join(firsts.select(order), order, "left_anti")
    if set(df.columns) == {*columns, order}:
        return firsts.select(*df.columns), removed
    return df.join(firsts.select(order), order, "left_semi"), removed


def canonicalize(
    df: DataFrame, source: str, labels: dict[str, str], target: str, what: str = "vehicle class"
) -> DataFrame:
    """Map a category to its canonical label; a value outside the map fails the job and is named."""
    return df.withColumn(target, decode_or_raise(source, category_key(source), labels, what))


def derive_ratios(
    df: DataFrame,
    city: str = "fuel_cons_city_l_100km",
    highway: str = "fuel_cons_hwy_l_100km",
    combined: str = "fuel_cons_comb_l_100km",
    emissions: str = "co2_emissions_g_km",
) -> DataFrame:
    """City-highway gap and ratio and emissions per combined litre, rounded half to even."""
    number = {name: F.col(name).cast("double") for name in (city, highway, combined, emissions)}
    return df.withColumns(
        {
            "city_hwy_gap_l_100km": half_even(number[city] - number[highway], 3).cast("decimal(6,3)"),
            "city_hwy_ratio": half_even(safe_ratio(number[city], number[highway]), 6).cast("decimal(16,6)"),
            "co2_per_comb_l": half_even(safe_ratio(number[emissions], number[combined]), 6).cast("decimal(16,6)"),
        }
    )


def temporal_split(
    df: DataFrame,
    period: str = "model_year",
    train_until: int = S.TRAIN_UNTIL,
    validate_until: int = S.VALIDATE_UNTIL,
    name: str = "model_split",
) -> DataFrame:
    return df.withColumn(name, period_label(period, train_until, validate_until))


def canonical_columns(df: DataFrame) -> DataFrame:
    """Canonical text, codes, labels and typed measures of a renamed raw table; row by row, no shuffle.

    With the columns derived from them they make a stage too wide to be compiled as one method.
    """
    leave_wide_stages_unfused(df.sparkSession)
    cleaned = df.withColumns(
        {
            "make": normalize_text("make"),
            "model": normalize_text("model"),
            "vehicle_class_raw": strip("vehicle_class_raw"),
            "transmission": normalize_text("transmission"),
            "fuel_type_code": normalize_text("fuel_type_code"),
            "engine_size_l": F.col("engine_size_l").cast("decimal(4,1)"),
            "fuel_cons_city_l_100km": F.col("fuel_cons_city_l_100km").cast("decimal(5,1)"),
            "fuel_cons_hwy_l_100km": F.col("fuel_cons_hwy_l_100km").cast("decimal(5,1)"),
            "fuel_cons_comb_l_100km": F.col("fuel_cons_comb_l_100km").cast("decimal(5,1)"),
            "co2_rating": F.col("co2_rating").cast("int"),
            "smog_rating": F.col("smog_rating").cast("int"),
        }
    )
    coded = canonicalize(cleaned, "vehicle_class_raw", S.VEHICLE_CLASSES, "vehicle_class").withColumns(
        {
            "transmission_family_code": leading_letters("transmission"),
            "gear_count": trailing_number("transmission"),
            "fuel_type": decode("fuel_type_code", S.FUEL_TYPES),
        }
    )
    return coded.withColumn(
        "transmission_family", decode("transmission_family_code", S.TRANSMISSION_FAMILIES)
    )


def banded_columns(df: DataFrame) -> DataFrame:
    """Engine and emission bands and the city-below-highway flag."""
    return df.withColumns(
        {
            "engine_size_band": bucketize("engine_size_l", S.ENGINE_EDGES, S.ENGINE_LABELS),
            "emission_band": bucketize(
                "co2_emissions_g_km", S.EMISSION_EDGES, S.EMISSION_LABELS, right=False
            ),
            "city_below_highway_flag": flag(
                F.col("fuel_cons_city_l_100km") < F.col("fuel_cons_hwy_l_100km")
            ),
        }
    )


def clean_ratings(
    raw: DataFrame,
    order: str = "source_row_number",
    train_until: int = S.TRAIN_UNTIL,
    validate_until: int = S.VALIDATE_UNTIL,
) -> DataFrame:
    """Raw ratings with a source row number to the 34-column clean table.

    The duplicate-free, labelled rows are stored once. The peer counts and the key chunks then read
    only the few columns they need, and neither they nor a lost task repeats the duplicate count.
    """
    columns = list(S.COLUMN_MAP)
    check_header(raw.select(*[c for c in raw.columns if c != order]))
    kept, _ = split_exact_duplicates(raw, columns, order)
    labelled = banded_columns(derive_ratios(canonical_columns(rename(kept))))
    split = temporal_split(labelled, "model_year", train_until, validate_until)
    benchmarked = peer_benchmark(stored(split, "canonical"), ["model_year", "vehicle_class"], "co2_emissions_g_km")
    return dense_key(benchmarked, order, "vehicle_id").select(*S.CLEAN_COLUMNS)


# fixed values: steps of the cleaning log and their reasons
_STEPS = (
    ("source ingestion", "Read supplied CSV without modifying it"),
    ("exact duplicate removal", "Remove only fully identical records"),
    ("canonicalization and feature engineering", "Standardize names and create auditable peer benchmarks"),
)


def cleaning_log(raw: DataFrame, columns: list[str], order: str) -> DataFrame:
    """Rows before and after each cleaning step, from one count of the raw table."""
    counted = first_of_copies(raw, columns, order).agg(
        F.coalesce(F.sum("copies"), F.lit(0)).cast("long").alias("source_rows"),
        F.count(F.lit(1)).alias("kept_rows"),
    )
    source, kept = F.col("source_rows"), F.col("kept_rows")
    counts = [(source, source), (source, kept), (kept, kept)]
    entries = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(step).alias("step"),
            before.alias("rows_before"),
            after.alias("rows_after"),
            (before - after).alias("rows_removed"),
            F.lit(reason).alias("reason"),
        )
        for i, ((step, reason), (before, after)) in enumerate(zip(_STEPS, counts, strict=True), start=1)
    ]
    return counted.select(F.inline(F.array(*entries)))
