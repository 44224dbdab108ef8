"""Data-quality audit: rule counts, profiles, relationships, cardinalities, the audit record."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ratingloom.functions.numeric import any_of, outside, outside_band, safe_ratio
from ratingloom.operators.joins import join_on_keys
from ratingloom.operators.quantiles import ROWS, quantiles_of_counts, value_counts
from ratingloom.session import stored
from ratingloom.sources import schema as S

CONSUMPTION = ["fuel_cons_city_l_100km", "fuel_cons_hwy_l_100km", "fuel_cons_comb_l_100km"]
INFORMATIONAL = {"clean_rows", "unique_vehicle_ids", "city_below_highway_rows"}
NUMERIC_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def _not_positive(name: str) -> Column:
    return F.count_if(F.coalesce(F.col(name) <= 0, F.lit(False)))


def _bad_rating(name: str) -> Column:
    return F.count_if(F.col(name).isNotNull() & outside(name, *S.RATING_RANGE))


def dq_checks(
    clean: DataFrame,
    first_year: int = S.FIRST_YEAR,
    last_year: int = S.LAST_YEAR,
    required: list[str] | None = None,
) -> DataFrame:
    """Fourteen rule counts in one row and one pass.

    A null counts as outside a required range, but not as a non-positive measure or a bad rating.
    """
    missing = [F.col(name).isNull().cast("int") for name in required or S.REQUIRED_COLUMNS]
    return clean.agg(
        F.count(F.lit(1)).alias("clean_rows"),
        F.count_distinct("vehicle_id").alias("unique_vehicle_ids"),
        F.coalesce(F.sum(reduce(lambda a, b: a + b, missing)), F.lit(0)).cast("long").alias("missing_required_values"),
        F.count_if(outside("model_year", first_year, last_year)).alias("invalid_model_year"),
        _not_positive("engine_size_l").alias("invalid_engine_size"),
        _not_positive("cylinders").alias("invalid_cylinders"),
        F.count_if(any_of(CONSUMPTION, lambda c: c <= 0)).alias("invalid_consumption"),
        _not_positive("co2_emissions_g_km").alias("invalid_co2"),
        _bad_rating("co2_rating").alias("invalid_co2_rating"),
        _bad_rating("smog_rating").alias("invalid_smog_rating"),
        F.count_if(F.col("fuel_type").isNull()).alias("unmapped_fuel_codes"),
        F.count_if(F.col("transmission_family").isNull()).alias("unmapped_transmission_codes"),
        F.count_if(
            outside_band("fuel_cons_comb_l_100km", CONSUMPTION[:2], _decimal(S.BLEND_TOLERANCE))
        ).alias("combined_outside_city_highway_range"),
        F.coalesce(F.sum("city_below_highway_flag"), F.lit(0)).cast("long").alias("city_below_highway_rows"),
    )


def _decimal(value: float):
    from decimal import Decimal

    return Decimal(str(value))


def enforce(checks: DataFrame, informational: set[str] = INFORMATIONAL) -> dict[str, int]:
    """The counts, or an error naming every broken rule."""
    counts = checks.first().asDict()
    broken = {k: v for k, v in counts.items() if k not in informational and v != 0}
    if counts["unique_vehicle_ids"] != counts["clean_rows"]:
        broken["unique_vehicle_ids"] = counts["unique_vehicle_ids"]
    if broken:
        raise AssertionError(f"cleaning rules broken: {broken}")
    return counts


def dq_checkpoint(fact: DataFrame, codes: list[str] | None = None, key: str = "vehicle_id") -> DataFrame:
    """Row count, key count, period range, missing targets and unknown codes after a load."""
    known = codes or list(S.FUEL_TYPES)
    return fact.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_distinct(key).alias("unique_vehicle_ids"),
        F.min("model_year").alias("first_model_year"),
        F.max("model_year").alias("latest_model_year"),
        F.count_if(F.col("co2_emissions_g_km").isNull()).alias("missing_target_rows"),
        F.count_if(~F.col("fuel_type_code").isin(known)).alias("invalid_fuel_code_rows"),
    )


def constraint_counts(fact: DataFrame, first_year: int = S.FIRST_YEAR, last_year: int = S.LAST_YEAR) -> DataFrame:
    """Rows that break a check or enumeration constraint of the fact table; null never breaks one."""
    broken = {
        "chk_vehicle_year": ~F.col("model_year").between(first_year, last_year),
        "chk_engine_size": F.col("engine_size_l") <= 0,
        "chk_cylinders": F.col("cylinders") <= 0,
        "chk_consumption": any_of(CONSUMPTION, lambda c: c <= 0),
        "chk_co2": F.col("co2_emissions_g_km") <= 0,
        "chk_co2_rating": ~F.col("co2_rating").between(*S.RATING_RANGE),
        "chk_smog_rating": ~F.col("smog_rating").between(*S.RATING_RANGE),
        "enum_model_split": ~F.col("model_split").isin("train", "validation", "test"),
    }
    counted = fact.agg(*[F.count_if(rule).alias(name) for name, rule in broken.items()])
    return counted.unpivot([], list(broken), "constraint_name", "violations")


def numeric_columns(df: DataFrame) -> list[str]:
    return [name for name, kind in df.dtypes if kind.startswith(NUMERIC_TYPES)]


def _column_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, value, rows) for all named columns in one scan, stored once for everything that is asked of them."""
    numbers = df.select(*[F.col(name).cast("double").alias(name) for name in columns])
    counts = value_counts(numbers.unpivot([], columns, "column_name", "value"), "value", ["column_name"])
    return stored(counts, "column-counts")


def numeric_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Count, minimum, maximum, mean and median of every numeric column; unknown values left out."""
    names = columns or numeric_columns(df)
    counts = _column_counts(df, names)
    moments = counts.groupBy("column_name").agg(
        F.sum(ROWS).alias("value_count"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
        (F.sum(F.col("value") * F.col(ROWS)) / F.sum(ROWS)).alias("mean_value"),
    )
    medians = quantiles_of_counts(counts, "value", {"median_value": 0.5}, ["column_name"])
    return join_on_keys(moments, medians, ["column_name"])


def iqr_outliers(df: DataFrame, columns: list[str], reach: float = 1.5) -> DataFrame:
    """Values strictly beyond ``reach`` interquartile ranges from the quartiles, per column."""
    counts = _column_counts(df, columns)
    quartiles = quantiles_of_counts(counts, "value", {"q1": 0.25, "q3": 0.75}, ["column_name"])
    spread = (F.col("q3") - F.col("q1")) * F.lit(reach)
    bounds = quartiles.select(
        "column_name",
        (F.col("q1") - spread).alias("lower_bound"),
        (F.col("q3") + spread).alias("upper_bound"),
    )
    beyond = (F.col("value") < F.col("lower_bound")) | (F.col("value") > F.col("upper_bound"))
    return (
        join_on_keys(counts, bounds, ["column_name"])
        .groupBy("column_name", "lower_bound", "upper_bound")
        .agg(F.sum(F.when(beyond, F.col(ROWS)).otherwise(0)).alias("outlier_rows"))
    )


def missing_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Unknown values per column."""
    names = columns or df.columns
    counted = df.agg(*[F.count_if(F.col(name).isNull()).alias(name) for name in names])
    return counted.unpivot([], names, "column_name", "missing_values")


def cardinalities(df: DataFrame, columns: dict[str, str | Column]) -> DataFrame:
    """Exact distinct counts of named columns or expressions; unknown values are not counted.

    Pairs of (name, value) are made distinct before they are counted, so no value set sits in one task.
    """
    spelled = {
        label: (F.col(source) if isinstance(source, str) else source).cast("string")
        for label, source in columns.items()
    }
    pairs = df.select(*[expr.alias(label) for label, expr in spelled.items()]).unpivot(
        [], list(spelled), "column_name", "value"
    )
    distinct = pairs.groupBy("column_name", "value").agg(F.lit(1).alias("one"))
    return distinct.groupBy("column_name").agg(F.count("value").alias("distinct_values"))


def availability(df: DataFrame, columns: list[str], period: str = "model_year") -> DataFrame:
    """Known values of sparse columns and the first period that has one."""
    named = {}
    for name in columns:
        named[f"{name}_nonmissing"] = F.count(name)
        named[f"{name}_first_year"] = F.min(F.when(F.col(name).isNotNull(), F.col(period)))
    return df.agg(*[expr.alias(label) for label, expr in named.items()])


def correlation(df: DataFrame, x: str, y: str, name: str = "correlation") -> DataFrame:
    """Pearson correlation over rows where both values are known."""
    return df.agg(F.corr(F.col(x).cast("double"), F.col(y).cast("double")).alias(name))


def group_ols(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Least-squares line of ``y`` on ``x`` per group; R² is null where ``y`` does not vary."""
    across, up = F.col(x).cast("double"), F.col(y).cast("double")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count(F.lit(1)).alias(ROWS),
        F.regr_slope(up, across).alias("slope"),
        F.regr_intercept(up, across).alias("intercept"),
        F.when(F.regr_syy(up, across) > 0, F.regr_r2(up, across)).alias("r_squared"),
    )


def share_within(
    df: DataFrame,
    value: str,
    a: str,
    b: str,
    weights: tuple[float, float] = S.BLEND_WEIGHTS,
    tolerance: float = S.BLEND_TOLERANCE,
    name: str = "share_within",
) -> DataFrame:
    """Share of rows whose value lies within a tolerance of a weighted blend; unknown rows are outside."""
    blend = F.col(a) * F.lit(_decimal(weights[0])) + F.col(b) * F.lit(_decimal(weights[1]))
    near = F.coalesce(F.abs(F.col(value) - blend) <= F.lit(_decimal(tolerance)), F.lit(False))
    return df.agg(safe_ratio(F.count_if(near).cast("double"), F.count(F.lit(1)).cast("double")).alias(name))


def audit_report(raw: DataFrame, clean: DataFrame, raw_columns: list[str] | None = None) -> DataFrame:
    """The whole audit as one row of nested values, ready for a JSON sink.

    Each part is a small aggregate; the parts meet as scalar subqueries, so no detail row moves.
    """
    names = raw_columns or list(S.COLUMN_MAP)

    def one(df: DataFrame) -> Column:
        return df.select(F.struct(*df.columns)).scalar()

    def listed(df: DataFrame, order: str) -> Column:
        rows = df.agg(F.sort_array(F.collect_list(F.struct(order, *[c for c in df.columns if c != order]))))
        return rows.scalar()

    outlier_columns = ["engine_size_l", "cylinders", *CONSUMPTION, "fuel_economy_comb_mpg", "co2_emissions_g_km"]
    parts = {
        "missing_values": listed(missing_counts(raw, names), "column_name"),
        "validation_checks": one(dq_checks(clean)),
        "numeric_profile": listed(numeric_profile(clean), "column_name"),
        "unique_values": listed(
            cardinalities(
                clean,
                {
                    "canonical_make": "make",
                    "model": "model",
                    "raw_vehicle_class": "vehicle_class_raw",
                    "canonical_vehicle_class": "vehicle_class",
                    "transmission": "transmission",
                    "fuel_type": "fuel_type_code",
                },
            ),
            "column_name",
        ),
        "clean_rows": clean.agg(F.count(F.lit(1)).alias("n")).scalar(),
        "date_range": one(clean.agg(F.min("model_year").alias("min_model_year"), F.max("model_year").alias("max_model_year"))),
        "rating_availability": one(availability(clean, ["co2_rating", "smog_rating"])),
        "iqr_outliers": listed(iqr_outliers(clean, outlier_columns), "column_name"),
        "consumption_correlation": correlation(clean, "co2_emissions_g_km", "fuel_cons_comb_l_100km").scalar(),
        "fuel_relationships": listed(
            group_ols(clean, "fuel_type_code", "fuel_cons_comb_l_100km", "co2_emissions_g_km"), "fuel_type_code"
        ),
        "share_within_blend": share_within(clean, "fuel_cons_comb_l_100km", *CONSUMPTION[:2]).scalar(),
    }
    counted = raw.agg(F.count(F.lit(1)).alias("source_rows"))
    return counted.select(
        "source_rows",
        *[part.alias(name) for name, part in parts.items() if name == "clean_rows"],
        (F.col("source_rows") - parts["clean_rows"]).alias("rows_removed_as_exact_duplicates"),
        F.lit(len(names)).alias("source_columns"),
        F.array(*[F.struct(F.lit(n).alias("column_name"), F.lit(t).alias("data_type")) for n, t in raw.dtypes if n in names]).alias("source_types"),
        F.array(*[F.lit(n) for n in S.LEAKY_COLUMNS]).alias("excluded_from_primary_model"),
        *[expr.alias(name) for name, expr in parts.items() if name != "clean_rows"],
    )


def with_provenance(report: DataFrame, files: DataFrame, seconds: float, features: list[str]) -> DataFrame:
    """The audit with the files it read (path, bytes, SHA-256), the seconds it took and what a model may see."""
    read = files.agg(F.sort_array(F.collect_list(F.struct("file", "bytes", "sha256")))).scalar()
    return report.select(
        read.alias("source_files"),
        F.lit(float(seconds)).alias("elapsed_seconds"),
        F.array(*[F.lit(n) for n in features]).alias("features_of_primary_model"),
        *report.columns,
    )
