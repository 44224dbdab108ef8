"""Pre-aggregated segment cubes and the interactive questions asked of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ratingloom.functions.numeric import column, decimal_mean, label_position, safe_ratio
from ratingloom.functions.text import contains_literal
from ratingloom.operators.benchmarks import COMBINED, EMISSIONS, ENGINE, GAP, records
from ratingloom.operators.joins import with_one_row
from ratingloom.operators.ordering import top_n
from ratingloom.session import stored

SEGMENT_KEYS = ["model_year", "vehicle_class", "make", "model", "fuel_type"]
WEIGHT = "vehicle_records"


def segment_summary(detail: DataFrame) -> DataFrame:
    """Records and averages per year, class, make, model and fuel."""
    return detail.groupBy(*SEGMENT_KEYS).agg(
        records(),
        decimal_mean(EMISSIONS).alias("average_co2_g_km"),
        decimal_mean(COMBINED, 1).alias("average_combined_l_100km"),
        decimal_mean(ENGINE, 1).alias("average_engine_size_l"),
        decimal_mean(GAP, 3).alias("average_peer_gap_g_km"),
    )


def engine_band_summary(detail: DataFrame) -> DataFrame:
    """The segment cube with the engine band as a sixth key."""
    return detail.groupBy(*SEGMENT_KEYS, "engine_size_band").agg(
        records(),
        decimal_mean(COMBINED, 1).alias("average_combined_l_100km"),
        decimal_mean(EMISSIONS).alias("average_co2_g_km"),
    )


def filter_segments(
    df: DataFrame,
    years: tuple[int, int] | None = None,
    classes: list[str] | None = None,
    fuels: list[str] | None = None,
    makes: list[str] | None = None,
) -> DataFrame:
    """Inclusive year range and optional value lists; an empty list does not filter."""
    if years:
        df = df.where(F.col("model_year").between(*years))
    for name, wanted in (("vehicle_class", classes), ("fuel_type", fuels), ("make", makes)):
        if wanted:
            df = df.where(F.col(name).isin(wanted))
    return df


def search(df: DataFrame, text: str, columns: list[str] | None = None) -> DataFrame:
    """Rows with a literal, case-insensitive substring in make or model; empty text keeps all rows."""
    names = [name for name in columns or ["make", "model"] if name in df.columns]
    return df.where(contains_literal(names, text)) if text and names else df


def _weighted_mean(value: str, weight: str, drop_unknown: bool) -> Column:
    number, share = F.col(value).cast("double"), F.col(weight)
    counted = F.when(F.col(value).isNotNull(), share) if drop_unknown else share
    return safe_ratio(F.sum(number * share), F.sum(counted).cast("double"))


def weighted_average(df: DataFrame, value: str, weight: str = WEIGHT, name: str | None = None) -> DataFrame:
    """One weighted mean; rows with an unknown value lose their weight, a zero weight gives null."""
    return df.agg(_weighted_mean(value, weight, drop_unknown=True).alias(name or value))


def aggregate_weighted(df: DataFrame, keys: list[str], values: list[str], weight: str = WEIGHT) -> DataFrame:
    """Roll a cube up to coarser keys; unknown values keep their weight, an unknown key is a group."""
    return df.groupBy(*keys).agg(
        F.sum(weight).alias(weight),
        *[_weighted_mean(value, weight, drop_unknown=False).alias(value) for value in values],
    )


def entity_cube(df: DataFrame, keys: list[str], entity: str) -> DataFrame:
    """(keys, entity_bucket, entities): which entities every cell holds, as bitmaps that can be merged.

    Entities are whole numbers, best dense ones. A bitmap covers 32,768 of them in 4 KB, so a cell costs at most 4 KB for
    each range it touches and no entity is stored twice, however many rows it has.
    """
    known = df.where(F.col(entity).isNotNull()).withColumn("__entity", F.col(entity).cast("long"))
    bucket = F.bitmap_bucket_number("__entity").alias("entity_bucket")
    bits = F.bitmap_construct_agg(F.bitmap_bit_position("__entity")).alias("entities")
    return known.groupBy(*keys, bucket).agg(bits)


def distinct_entities(cube: DataFrame, keys: list[str] | tuple = (), name: str = "distinct_entities") -> DataFrame:
    """Exact distinct counts of a filtered entity cube, per group of ``keys``; the rows are not read again."""
    merged = cube.groupBy(*keys, "entity_bucket").agg(F.bitmap_or_agg("entities").alias("entities"))
    return merged.groupBy(*keys).agg(F.coalesce(F.sum(F.bitmap_count("entities")), F.lit(0)).cast("long").alias(name))


def segment_kpis(df: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """Records, weighted averages and number of years of a filtered cube; with an entity cube under the same filter also
    its distinct entities."""
    found = df.agg(
        F.coalesce(F.sum(WEIGHT), F.lit(0)).cast("long").alias("vehicle_configurations"),
        _weighted_mean("average_co2_g_km", WEIGHT, True).alias("average_co2_g_km"),
        _weighted_mean("average_combined_l_100km", WEIGHT, True).alias("average_combined_l_100km"),
        _weighted_mean("average_peer_gap_g_km", WEIGHT, True).alias("average_peer_gap_g_km"),
        F.count_distinct("model_year").alias("model_years"),
    )
    return found if entities is None else found.withColumn("distinct_entities", distinct_entities(entities).scalar())


def guard_or_all(df: DataFrame, minimum: int, count: str = WEIGHT) -> DataFrame:
    """Groups with enough records, or every group when none has enough."""
    most = df.agg(F.coalesce(F.max(count), F.lit(0)).alias("most")).scalar()
    return df.where((F.col(count) >= minimum) | (most < F.lit(minimum)))


def category_mix(df: DataFrame, key: str, value: str, limit: int = 6, other: str = "Other") -> DataFrame:
    """Sums per category; beyond ``limit`` categories the smallest fold into one row.

    Only ``limit`` rows are ever ranked. Categories outside them are summed where they are, and ties at
    the cut go to the smaller key. The sums are stored, because they are read four times.
    """
    sums = df.groupBy(key).agg(F.sum(value).alias(value))
    grouped = stored(sums, "categories").where(F.col(key).isNotNull())
    groups = grouped.agg(F.count(F.lit(1))).scalar()
    order = [f"-{value}", key]
    few = top_n(grouped, order, limit).where(groups <= limit)
    visible = top_n(grouped, order, limit - 1)
    rest = grouped.join(visible.select(key), key, "left_anti").agg(F.sum(value).alias(value))
    folded = rest.select(F.lit(other).alias(key), value)
    return few.unionByName(visible.unionByName(folded).where(groups > limit))


def group_sizes(df: DataFrame, key: str, name: str = "configurations") -> DataFrame:
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(name))


def opportunity_mix(df: DataFrame, key: str = "vehicle_class", limit: int = 6) -> DataFrame:
    return category_mix(group_sizes(df, key), key, "configurations", limit)


def histogram(df: DataFrame, value: str, bins: int = 18) -> DataFrame:
    """Rows per equal-width bin between minimum and maximum; the maximum belongs to the last bin."""
    known = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("value"))
    ends = known.agg(F.min("value").alias("lowest"), F.max("value").alias("highest"))
    spread = with_one_row(known, ends)
    width = (F.col("highest") - F.col("lowest")) / F.lit(bins)
    spot = F.coalesce(F.floor(safe_ratio(F.col("value") - F.col("lowest"), width)), F.lit(0)) + 1
    binned = spread.select(F.least(spot, F.lit(bins)).cast("int").alias("bin"), "lowest", width.alias("width"))
    return binned.groupBy("bin").agg(
        F.first(F.col("lowest") + (F.col("bin") - 1) * F.col("width")).alias("bin_start"),
        F.first(F.col("lowest") + F.col("bin") * F.col("width")).alias("bin_end"),
        F.count(F.lit(1)).alias("configurations"),
    )


def order_by_labels(df: DataFrame, name: str, labels: list[str]) -> DataFrame:
    """Sort by the documented order of a category instead of its spelling."""
    return df.orderBy(label_position(name, labels), name)


def scaled_size(df: DataFrame, value: str, name: str, low: float = 34, span: float = 46) -> DataFrame:
    """``low`` plus ``span`` times the share of the largest value."""
    largest = df.agg(F.max(value).alias("largest")).scalar()
    return df.withColumn(name, F.lit(low) + safe_ratio(column(value), largest) * F.lit(span))
