"""Peer-gap opportunities and distance scenarios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ratingloom.functions.numeric import column
from ratingloom.functions.text import joined_label
from ratingloom.operators.benchmarks import EMISSIONS, GAP
from ratingloom.operators.ordering import order_columns, top_n, with_rank, with_tile
from ratingloom.sources.schema import RECENT_SINCE

GRAMS_PER_TONNE = 1_000_000
RANK_NAME = "within_class_opportunity_rank"
PEERS = ["model_year", "vehicle_class"]


def opportunities(detail: DataFrame, since: int = RECENT_SINCE) -> DataFrame:
    """Recent rows above their peers' lower quartile."""
    return detail.where((F.col("model_year") >= since) & (F.col(GAP) > 0))


def ranked_opportunities(detail: DataFrame, since: int = RECENT_SINCE) -> DataFrame:
    """The opportunities ranked by gap, then emissions, among their peers."""
    return with_rank(opportunities(detail, since), [f"-{GAP}", f"-{EMISSIONS}"], PEERS, RANK_NAME)


def top_opportunities(
    fact: DataFrame, since: int = RECENT_SINCE, n: int = 500, tie: list[str] | tuple = ("vehicle_id",)
) -> DataFrame:
    """The ``n`` recent rows with the largest gap, then emissions; gaps of zero stay eligible."""
    recent = fact.where(F.col("model_year") >= since)
    return top_n(recent, [f"-{GAP}", f"-{EMISSIONS}", *tie], n)


def export_opportunities(view: DataFrame, n: int = 500, tie: list[str] | tuple = ("vehicle_id",)) -> DataFrame:
    """The ``n`` rows of the opportunity view with the largest gap; ties go to the smaller key."""
    return top_n(view, [f"-{GAP}", *tie], n)


def opportunity_quartile(
    fact: DataFrame,
    since: int = RECENT_SINCE,
    tiles: int = 4,
    keep: int = 1,
    tie: list[str] | tuple = ("vehicle_id",),
) -> DataFrame:
    """Recent rows in the first gap quartile of their peers."""
    columns = ["vehicle_id", *PEERS, "make", "model", EMISSIONS, "class_year_co2_p25", GAP]
    recent = fact.where(F.col("model_year") >= since).select(*columns)
    tiled = with_tile(recent, [f"-{GAP}", *tie], tiles, PEERS, "opportunity_quartile")
    kept = tiled.where(F.col("opportunity_quartile") == keep)
    return kept.orderBy(*order_columns([f"-{GAP}", f"-{EMISSIONS}", *tie]))


def top_gap_labels(view: DataFrame, n: int = 6, tie: list[str] | tuple = ("vehicle_id",)) -> DataFrame:
    """The largest gaps with a make and model label, smallest of them first for display."""
    top = top_n(view, [f"-{GAP}", *tie], n).withColumn("vehicle_label", joined_label("make", "model"))
    return top.orderBy(*order_columns([GAP, *tie]))


def tonnes(gap: Column | str, kilometres: Column | int, vehicles: Column | int) -> Column:
    """Grams per kilometre over a yearly distance and fleet, in tonnes."""
    km = kilometres if isinstance(kilometres, Column) else F.lit(kilometres)
    fleet = vehicles if isinstance(vehicles, Column) else F.lit(vehicles)
    return column(gap).cast("double") * km * fleet / F.lit(GRAMS_PER_TONNE)


def mean_gap(df: DataFrame) -> DataFrame:
    total = F.sum(F.col(GAP).cast("decimal(18,3)")).cast("double")
    return df.agg(
        F.count(F.lit(1)).alias("configurations_screened"),
        (total / F.nullif(F.count(GAP), F.lit(0))).alias("average_gap"),
    )


def scenario(df: DataFrame, kilometres: int = 20_000, vehicles: int = 1_000) -> DataFrame:
    """Configurations, average gap and the yearly tonnes the gap means for a fleet; one row."""
    return mean_gap(df).withColumn("scenario_tonnes", tonnes("average_gap", kilometres, vehicles))


def sensitivity(
    df: DataFrame, vehicles: int = 1_000, start: int = 5_000, stop: int = 50_000, step: int = 5_000
) -> DataFrame:
    """Scenario tonnes for a range of yearly distances."""
    distances = mean_gap(df).select(
        "average_gap", F.explode(F.sequence(F.lit(start), F.lit(stop), F.lit(step))).alias("annual_km")
    )
    return distances.select("annual_km", tonnes("average_gap", F.col("annual_km"), vehicles).alias("scenario_tonnes"))


def axis_bounds(df: DataFrame, *names: str) -> DataFrame:
    """Smallest and largest value over several columns, one row."""
    columns = [F.col(name).cast("double") for name in names]
    return df.agg(F.min(F.least(*columns)).alias("lowest"), F.max(F.greatest(*columns)).alias("highest"))
