"""Peer benchmarks, period trends and group summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ratingloom.functions.numeric import clip_lower, decimal_mean, flag, half_even, relative_change, safe_ratio
from ratingloom.operators.joins import join_on_keys, join_summary, latest_only
from ratingloom.operators.ordering import order_columns, summary_rank
from ratingloom.operators.quantiles import grouped_quantiles

EMISSIONS = "co2_emissions_g_km"
COMBINED = "fuel_cons_comb_l_100km"
ENGINE = "engine_size_l"
GAP = "co2_gap_to_class_p25"


def records() -> Column:
    return F.count(F.lit(1)).alias("vehicle_records")


def known_keys(keys: list[str]) -> Column:
    """Rows of a group whose keys are all known. A filter on this count stays above the grouping; one on the keys would be
    pushed down to the scan, where it repeats for every row all that the keys are made of."""
    unknown = reduce(lambda a, b: a | b, [F.col(key).isNull() for key in keys])
    return F.count(F.when(~unknown, F.lit(1))).alias("__known")


def peer_benchmark(
    df: DataFrame,
    keys: list[str],
    value: str,
    scale: int = 3,
) -> DataFrame:
    """Median and lower quartile of the peers on every row, with the distances to them.

    A row with an unknown key has no peers. The peer table holds one row per group; it is broadcast when it is small,
    otherwise the join shuffles and skewed groups are split.
    """
    stats = grouped_quantiles(df, value, {"__median": 0.5, "__p25": 0.25}, keys)
    kind = f"decimal(18,{scale})"
    peers = stats.dropna(subset=keys).select(
        *keys,
        half_even("__median", scale).cast(kind).alias("class_year_co2_median"),
        half_even("__p25", scale).cast(kind).alias("class_year_co2_p25"),
    )
    number = F.col(value).cast(kind)
    return join_summary(df, peers, keys).withColumns(
        {
            "co2_vs_class_year_median": (number - F.col("class_year_co2_median")).cast(kind),
            "co2_gap_to_class_p25": clip_lower(number - F.col("class_year_co2_p25")).cast(kind),
            "above_class_year_median": flag(number > F.col("class_year_co2_median")),
        }
    )


# --- trends over an ordered period; windows run on one row per period ---------------------------------


def with_lag(df: DataFrame, value: str, order: str, name: str) -> DataFrame:
    return df.withColumn(name, F.lag(value).over(Window.orderBy(order)))


def with_change(df: DataFrame, value: str, previous: str, name: str, scale: int = 8) -> DataFrame:
    return df.withColumn(name, relative_change(value, previous, scale))


def with_base_change(
    df: DataFrame, value: str, period: str, base, name: str, scale: int | None = 8, required: bool = False
) -> DataFrame:
    """Change against the row of the base period.

    Without that row the result is empty, or an error when ``required``.
    """
    everything = Window.partitionBy()
    is_base = F.col(period) == F.lit(base)
    marked = df.withColumns(
        {
            "__base": F.max(F.when(is_base, F.col(value))).over(everything),
            "__found": F.coalesce(F.max(is_base.cast("int")).over(everything), F.lit(0)) == 1,
        }
    )
    if required:
        missing = F.raise_error(F.lit(f"no row for base period {base}"))
        marked = marked.withColumn("__found", F.when(F.col("__found"), F.lit(True)).otherwise(missing.cast("boolean")))
    change = safe_ratio(value, "__base") - F.lit(1)
    change = change if scale is None else F.round(change, scale)
    return marked.where("__found").withColumn(name, change).drop("__base", "__found")


def rolling_mean(df: DataFrame, value: str, order: str, name: str, n: int = 3) -> DataFrame:
    """Mean over the current and the ``n - 1`` preceding rows; missing periods are not filled in."""
    frame = Window.orderBy(order).rowsBetween(-(n - 1), Window.currentRow)
    return df.withColumn(name, F.avg(value).over(frame))


def _means(combined: bool = True, engine: bool = True, gap: bool = True) -> list[Column]:
    means = [decimal_mean(EMISSIONS).alias("average_co2_g_km")]
    if combined:
        means.append(decimal_mean(COMBINED, 1).alias("average_combined_l_100km"))
    if engine:
        means.append(decimal_mean(ENGINE, 1).alias("average_engine_size_l"))
    if gap:
        means.append(decimal_mean(GAP, 3).alias("average_peer_gap_g_km"))
    return means


def yearly_means(fact: DataFrame, **which: bool) -> DataFrame:
    return fact.groupBy("model_year").agg(records(), *_means(**which))


def yearly_trend(fact: DataFrame, base: int = 1995) -> DataFrame:
    """Yearly averages with the previous year, the yearly change and the change since the base year."""
    lagged = with_lag(yearly_means(fact), "average_co2_g_km", "model_year", "previous_year_average_co2")
    moved = with_change(lagged, "average_co2_g_km", "previous_year_average_co2", "co2_yoy_change_pct")
    return with_base_change(
        moved, "average_co2_g_km", "model_year", base, "co2_change_vs_1995_pct"
    )


def yoy_movement(fact: DataFrame) -> DataFrame:
    """Yearly averages with the movement against the previous year."""
    yearly = yearly_means(fact, engine=False, gap=False)
    lagged = with_lag(yearly, "average_co2_g_km", "model_year", "previous_year_co2")
    return with_change(lagged, "average_co2_g_km", "previous_year_co2", "co2_yoy_change_pct")


def rolling_trend(fact: DataFrame, n: int = 3) -> DataFrame:
    yearly = fact.groupBy("model_year").agg(decimal_mean(EMISSIONS).alias("average_co2_g_km"))
    return rolling_mean(yearly, "average_co2_g_km", "model_year", "rolling_three_year_average_co2", n)


def _plain_means(gap: bool = True) -> list[Column]:
    """Unrounded averages: exact sums divided once."""

    def mean(name: str, scale: int) -> Column:
        total = F.sum(F.col(name).cast(f"decimal(18,{scale})")).cast("double")
        return safe_ratio(total, F.count(name).cast("double"))

    means = [
        mean(EMISSIONS, 0).alias("average_co2_g_km"),
        mean(COMBINED, 1).alias("average_combined_l_100km"),
        mean(ENGINE, 1).alias("average_engine_size_l"),
    ]
    return means + ([mean(GAP, 3).alias("average_peer_gap_g_km")] if gap else [])


def yearly_summary(fact: DataFrame, base: int = 1995) -> DataFrame:
    """Unrounded yearly averages and median; a missing base year is an error."""
    fact = fact.dropna(subset=["model_year"])
    yearly = fact.groupBy("model_year").agg(records(), *_plain_means())
    medians = grouped_quantiles(fact, EMISSIONS, {"median_co2_g_km": 0.5}, ["model_year"])
    full = with_lag(join_on_keys(yearly, medians, ["model_year"]), "average_co2_g_km", "model_year", "__last")
    moved = full.withColumn(
        "co2_yoy_change_pct", safe_ratio("average_co2_g_km", "__last") - F.lit(1)
    ).drop("__last")
    return with_base_change(
        moved, "average_co2_g_km", "model_year", base, "co2_change_vs_1995_pct", scale=None, required=True
    )


def class_year_stats(fact: DataFrame) -> DataFrame:
    """Class-year averages with median and lower quartile recomputed, highest average first."""
    keys = ["model_year", "vehicle_class"]
    spread = grouped_quantiles(fact, EMISSIONS, {"median_co2_g_km": 0.5, "p25_co2_g_km": 0.25}, keys)
    summary = fact.groupBy(*keys).agg(records(), *_plain_means(), known_keys(keys))
    known = summary.where(F.col("__known") > 0).drop("__known")
    return join_on_keys(known, spread, keys).orderBy(
        *order_columns(["model_year", "-average_co2_g_km", "vehicle_class"])
    )


def class_benchmark(fact: DataFrame) -> DataFrame:
    """Class-year averages of the fact and of its stored peer columns, ranked high to low in each year."""
    keys = ["model_year", "vehicle_class"]
    summary = fact.groupBy(*keys).agg(
        records(),
        *_means(),
        decimal_mean("class_year_co2_median", 3).alias("median_co2_g_km"),
        decimal_mean("class_year_co2_p25", 3).alias("p25_co2_g_km"),
    )
    return summary_rank(summary, ["-average_co2_g_km"], ["model_year"], "high_to_low_emission_rank")


def make_benchmark(fact: DataFrame) -> DataFrame:
    """Make-year averages ranked low to high in each year."""
    summary = fact.groupBy("model_year", "make").agg(records(), *_means())
    return summary_rank(summary, ["average_co2_g_km"], ["model_year"], "low_to_high_emission_rank")


def make_year_summary(fact: DataFrame) -> DataFrame:
    """Unrounded make-year averages without a rank."""
    keys = ["model_year", "make"]
    summary = fact.groupBy(*keys).agg(records(), *_plain_means(), known_keys(keys))
    return summary.where(F.col("__known") > 0).drop("__known")


SUMMARY_KEYS = {
    "fuel_type_year_summary": ["model_year", "fuel_type_code", "fuel_type"],
    "engine_band_year_summary": ["model_year", "engine_size_band"],
    "transmission_year_summary": ["model_year", "transmission_family_code", "transmission_family"],
}


def group_summaries(fact: DataFrame, specs: dict[str, list[str]] | None = None) -> dict[str, DataFrame]:
    """One unrounded summary per key list; rows with an unknown key are left out."""
    found = {}
    for name, keys in (specs or SUMMARY_KEYS).items():
        summary = fact.groupBy(*keys).agg(records(), *_plain_means(gap=False), known_keys(keys))
        found[name] = summary.where(F.col("__known") > 0).drop("__known")
    return found


# --- rankings of the latest period --------------------------------------------------------------------


def latest_class_rank(fact: DataFrame) -> DataFrame:
    latest = latest_only(fact, "model_year")
    summary = latest.groupBy("vehicle_class").agg(records(), *_means(engine=False, gap=False))
    return summary_rank(summary, ["-average_co2_g_km"], name="high_emission_rank")


def latest_make_rank(fact: DataFrame, min_records: int = 5) -> DataFrame:
    latest = latest_only(fact, "model_year")
    summary = latest.groupBy("make").agg(records(), *_means(combined=False, gap=False))
    guarded = summary.where(F.col("vehicle_records") >= min_records)
    return summary_rank(guarded, ["average_co2_g_km"], name="low_emission_rank")


def engine_band_case(fact: DataFrame, band: Column) -> DataFrame:
    """Averages by a band expression, in the order of the smallest engine of each band."""
    return (
        fact.groupBy(band.alias("engine_size_band"))
        .agg(records(), *_means(engine=False, gap=False), F.min(ENGINE).alias("__smallest"))
        .orderBy("__smallest", "engine_size_band")
        .drop("__smallest")
    )


def record_share(
    df: DataFrame, part: str, key: str, aggregates: list[Column] | None = None, scale: int = 4
) -> DataFrame:
    """Records of each key and their share of all records in the partition."""
    grouped = df.groupBy(part, key).agg(records(), *(aggregates or []))
    total = F.sum("vehicle_records").over(Window.partitionBy(part))
    share = F.round((F.col("vehicle_records") / total).cast("decimal(20,12)"), scale)
    return grouped.withColumn("record_share", share)


def fuel_mix_share(fact: DataFrame, fuel: str = "fuel_type_name") -> DataFrame:
    shares = record_share(fact, "model_year", fuel, [decimal_mean(EMISSIONS).alias("average_co2_g_km")])
    return shares.orderBy(*order_columns(["model_year", "-vehicle_records", fuel]))
