"""The nine reporting views."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ratingloom.functions.numeric import relative_change
from ratingloom.operators.benchmarks import class_benchmark, make_benchmark, yearly_means, yearly_trend
from ratingloom.operators.joins import attach_predictions, decode_join, with_one_row
from ratingloom.operators.metrics import METRICS, PREDICTION_COLUMNS, importance_rank, selected_metric, stack
from ratingloom.operators.scenario import ranked_opportunities
from ratingloom.sources import schema as S


@dataclass
class Tables:
    """The stored tables the views read."""

    ratings: DataFrame
    fuels: DataFrame
    transmissions: DataFrame
    predictions: DataFrame
    metrics: DataFrame
    importance: DataFrame
    segment_errors: DataFrame
    base_year: int = S.BASE_YEAR
    recent_since: int = S.RECENT_SINCE


def decoded(ratings: DataFrame, fuels: DataFrame, transmissions: DataFrame) -> DataFrame:
    """Ratings with the lookup names of fuel and transmission; rows without a name drop out."""
    coded = ratings.drop("fuel_type", "transmission_family")
    named = decode_join(decode_join(coded, fuels, "fuel_type_code"), transmissions, "transmission_family_code")
    return named.withColumnsRenamed(
        {"fuel_type_name": "fuel_type", "transmission_family_name": "transmission_family"}
    )


def vehicle_detail(ratings: DataFrame, fuels: DataFrame, transmissions: DataFrame, predictions: DataFrame) -> DataFrame:
    """Ratings with decoded names and, where scored, their prediction."""
    scores = predictions.select(*[c for c in PREDICTION_COLUMNS if c not in ("data_split", "actual_co2_g_km")])
    joined = attach_predictions(decoded(ratings, fuels, transmissions), scores, "vehicle_id")
    return joined.select(*S.DETAIL_COLUMNS)


def kpis(ratings: DataFrame, metrics: DataFrame, predictions: DataFrame) -> DataFrame:
    """Headline figures in one row; no row without an eligible test metric.

    All period figures come from one grouping by year.
    """
    yearly = yearly_means(ratings, engine=False)
    year = F.col("model_year")

    def at_latest(name: str) -> Column:
        return F.max_by(name, year)

    figures = yearly.agg(
        F.sum("vehicle_records").alias("vehicle_records"),
        F.min(year).alias("first_model_year"),
        F.max(year).alias("latest_model_year"),
        F.count(year).alias("years_covered"),
        at_latest("vehicle_records").alias("latest_year_records"),
        at_latest("average_co2_g_km").alias("latest_average_co2_g_km"),
        at_latest("average_combined_l_100km").alias("latest_average_combined_l_100km"),
        relative_change(at_latest("average_co2_g_km"), F.min_by("average_co2_g_km", year)).alias(
            "co2_change_first_to_latest_pct"
        ),
        at_latest("average_peer_gap_g_km").alias("latest_average_peer_gap_g_km"),
    )
    chosen = selected_metric(metrics).select(
        F.col("model_name").alias("selected_model"),
        F.col("mae").alias("test_mae_g_km"),
        F.col("rmse").alias("test_rmse_g_km"),
        F.col("mape").alias("test_mape"),
        F.col("r_squared").alias("test_r_squared"),
        F.col("p90_absolute_error").alias("test_p90_absolute_error_g_km"),
    )
    tested = predictions.where(F.col("data_split") == "test").agg(F.count(F.lit(1)).alias("test_records"))
    full = with_one_row(with_one_row(figures, tested), chosen)
    first = [*figures.columns, "selected_model", "test_records"]
    return full.select(*first, *[c for c in full.columns if c not in first])


def model_performance(metrics: DataFrame) -> DataFrame:
    return metrics.select(
        "metric_id", "model_name", "model_scope", "split", "eligible_for_selection", "fit_period", *METRICS
    )


def segment_error_view(segment_errors: DataFrame) -> DataFrame:
    return segment_errors.select(
        "segment_error_id",
        "segment_type",
        "segment_value",
        "vehicle_records",
        "average_actual_co2_g_km",
        "average_predicted_co2_g_km",
        *METRICS,
    )


def build_views(tables: Tables) -> dict[str, DataFrame]:
    detail = vehicle_detail(tables.ratings, tables.fuels, tables.transmissions, tables.predictions)
    return {
        "vehicle_detail": detail,
        "yearly_trend": yearly_trend(tables.ratings, tables.base_year),
        "class_benchmark": class_benchmark(tables.ratings),
        "make_benchmark": make_benchmark(tables.ratings),
        "model_performance": model_performance(tables.metrics),
        "feature_importance": importance_rank(tables.importance),
        "high_emission_opportunities": ranked_opportunities(detail, tables.recent_since),
        "test_segment_errors": segment_error_view(tables.segment_errors),
        "kpis": kpis(tables.ratings, tables.metrics, tables.predictions),
    }


def register_views(views: dict[str, DataFrame], prefix: str = "vw_dashboard_") -> list[str]:
    """Make the views available to ``spark.sql`` under a prefix."""
    for name, df in views.items():
        df.createOrReplaceTempView(prefix + name)
    return [prefix + name for name in views]


def view_counts(views: dict[str, DataFrame]) -> DataFrame:
    """Rows of every view."""
    return stack(
        *[df.agg(F.lit(name).alias("view_name"), F.count(F.lit(1)).alias("view_rows")) for name, df in views.items()]
    )


def missing_predictions(detail: DataFrame) -> DataFrame:
    return detail.agg(F.count_if(F.col("predicted_co2_g_km").isNull()).alias("missing_predictions"))


def assert_counts(counts: DataFrame, expected: dict[str, int | None], non_empty: list[str] | tuple = ()) -> dict[str, int]:
    """The counts, or an error where a view differs from its exact count or must not be empty."""
    found = {row.view_name: row.view_rows for row in counts.collect()}
    wrong = {n: found.get(n) for n, rows in expected.items() if rows is not None and found.get(n) != rows}
    empty = [name for name in non_empty if not found.get(name)]
    if wrong or empty:
        raise AssertionError(f"unexpected view rows {wrong}, empty views {empty}")
    return found


def export_set(tables: Tables, tuning: DataFrame, views: dict[str, DataFrame], limit: int = 500) -> dict[str, DataFrame]:
    """The ordered result tables that are written out as evidence."""
    def ordered(name: str, *by: Column | str) -> DataFrame:
        return views[name].orderBy(*by)

    return {
        "dashboard_kpis": views["kpis"],
        "yearly_trend": ordered("yearly_trend", "model_year"),
        "class_year_benchmark": ordered("class_benchmark", "model_year", F.desc("average_co2_g_km")),
        "make_year_summary": ordered("make_benchmark", "model_year", "average_co2_g_km"),
        "model_metrics": ordered("model_performance", "metric_id"),
        "model_tuning_results": tuning.orderBy("mae", "rmse"),
        "feature_importance": ordered("feature_importance", "importance_rank"),
        "high_emission_opportunities": ordered(
            "high_emission_opportunities", F.desc("co2_gap_to_class_p25"), "vehicle_id"
        ).limit(limit),
        "model_segment_errors": ordered("test_segment_errors", F.desc("mae"), "segment_error_id"),
    }
