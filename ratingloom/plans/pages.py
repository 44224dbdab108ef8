"""Result frames of the four report pages: filter, search, cube, roll-ups."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from ratingloom.functions.text import title_label
from ratingloom.operators import cube, metrics as M, scenario
from ratingloom.operators.ordering import order_columns, sample_cap, top_n, top_n_displayed
from ratingloom.sources import schema as S


@dataclass
class Filters:
    """What a reader of a page may choose; empty choices do not filter."""

    years: tuple[int, int] | None = None
    classes: list[str] = field(default_factory=list)
    fuels: list[str] = field(default_factory=list)
    makes: list[str] = field(default_factory=list)
    text: str = ""

    def apply(self, df: DataFrame) -> DataFrame:
        found = cube.search(df, self.text)
        return cube.filter_segments(found, self.years, self.classes, self.fuels, self.makes)


def engine_band_profile(bands: DataFrame) -> DataFrame:
    """Average consumption per engine band in band order, with a display size."""
    rolled = cube.aggregate_weighted(bands, ["engine_size_band"], ["average_combined_l_100km"])
    sized = cube.scaled_size(rolled, "average_combined_l_100km", "bubble_size")
    return cube.order_by_labels(sized, "engine_size_band", S.ENGINE_LABELS)


def top_n_classes(segments: DataFrame, n: int = 8) -> DataFrame:
    """Classes with the highest average emissions, lowest of them first."""
    rolled = cube.aggregate_weighted(segments, ["vehicle_class"], ["average_co2_g_km"])
    return top_n_displayed(
        rolled, ["-average_co2_g_km", "vehicle_class"], n, ["average_co2_g_km", "vehicle_class"]
    )


def overview(segments: DataFrame, bands: DataFrame, filters: Filters) -> dict[str, DataFrame]:
    chosen, chosen_bands = filters.apply(segments), filters.apply(bands)
    trend = cube.aggregate_weighted(chosen, ["model_year"], ["average_co2_g_km"])
    return {
        "kpis": cube.segment_kpis(chosen),
        "trend": trend.orderBy("model_year"),
        "fuel_mix": cube.category_mix(chosen, "fuel_type", cube.WEIGHT),
        "classes": top_n_classes(chosen),
        "engine_bands": engine_band_profile(chosen_bands),
    }


MAKE_VALUES = ["average_co2_g_km", "average_combined_l_100km", "average_peer_gap_g_km"]


def guarded_makes(segments: DataFrame, minimum: int = 5) -> DataFrame:
    """Make averages of makes with enough records, or of all makes when none has enough."""
    return cube.guard_or_all(cube.aggregate_weighted(segments, ["make"], MAKE_VALUES), minimum)


def guarded_make_rank(segments: DataFrame, minimum: int = 5, n: int = 10) -> DataFrame:
    """Guarded makes with the lowest average emissions, highest of them first."""
    return top_n_displayed(
        guarded_makes(segments, minimum), ["average_co2_g_km", "make"], n, ["-average_co2_g_km", "make"]
    )


def make_scatter(segments: DataFrame, minimum: int = 5, n: int = 40) -> DataFrame:
    """The guarded makes with most records."""
    return top_n(guarded_makes(segments, minimum), ["-vehicle_records", "make"], n)


def segments_page(segments: DataFrame, filters: Filters) -> dict[str, DataFrame]:
    chosen = filters.apply(segments)
    classes = cube.aggregate_weighted(chosen, ["vehicle_class"], ["average_co2_g_km", "average_peer_gap_g_km"])
    return {
        "kpis": cube.segment_kpis(chosen),
        "makes": make_scatter(chosen),
        "class_gaps": top_n_displayed(
            classes, ["-average_peer_gap_g_km", "vehicle_class"], 10, ["average_peer_gap_g_km", "vehicle_class"]
        ),
        "make_ranking": guarded_make_rank(chosen),
        "class_mix": cube.category_mix(chosen, "vehicle_class", cube.WEIGHT),
    }


def labelled_segments(segment_errors: DataFrame) -> DataFrame:
    """Segment errors with a readable segment type."""
    return segment_errors.withColumn("segment_label", title_label("segment_type"))


def model_page(
    metrics: DataFrame,
    importance: DataFrame,
    segment_errors: DataFrame,
    test_predictions: DataFrame,
    split: str = "test",
    segment_type: str | None = None,
    text: str = "",
    cap: int = 3_500,
    seed: int = 42,
) -> dict[str, DataFrame]:
    """Frames of the model page; ``test_predictions`` carries make and model so that it can be searched."""
    rows = cube.search(test_predictions, text)
    errors = labelled_segments(segment_errors)
    if segment_type:
        errors = errors.where(F.col("segment_type") == segment_type)
    chosen = M.selected_metric(metrics).select("model_name").scalar()
    eligible = (
        (F.col("split") == "validation")
        & (F.col("model_scope") == "early_specification")
        & (F.col("eligible_for_selection") == 1)
    )
    return {
        "selected": metrics.where((F.col("split") == split) & (F.col("model_name") == chosen)),
        "sample": sample_cap(rows, cap, seed, ["vehicle_id"]),
        "axis": scenario.axis_bounds(rows, M.ACTUAL, M.PREDICTED),
        "validation": metrics.where(eligible).orderBy(*order_columns(["-mae", "metric_id"])),
        "importance": top_n_displayed(
            importance,
            ["-importance_mean_mae_increase", "feature"],
            10,
            ["importance_mean_mae_increase", "feature"],
        ),
        "segments": top_n_displayed(errors, ["-mae", "segment_type", "segment_value"], 6, ["mae", "segment_value"]),
    }


def opportunity_page(
    view: DataFrame,
    filters: Filters,
    kilometres: int = 20_000,
    vehicles: int = 1_000,
    bins: int = 18,
    tie: list[str] | tuple = ("vehicle_id",),
) -> dict[str, DataFrame]:
    """Frames of the scenario page over the exported opportunities."""
    chosen = filters.apply(view)
    return {
        "kpis": scenario.scenario(chosen, kilometres, vehicles),
        "largest": scenario.top_gap_labels(chosen, tie=tie),
        "mix": cube.opportunity_mix(chosen),
        "sensitivity": scenario.sensitivity(chosen, vehicles),
        "distribution": cube.histogram(chosen, "co2_gap_to_class_p25", bins),
    }
