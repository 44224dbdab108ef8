"""Evaluation of scored rows: metric sets, segments, thresholds, ledgers, selection."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

from ratingloom.functions.numeric import (
    bucketize,
    decimal_mean,
    flag,
    floored_percentage_error,
    half_even,
    safe_ratio,
)
from ratingloom.operators.joins import join_eval, join_on_keys, with_one_row
from ratingloom.operators.ordering import order_columns, summary_rank, top_n, with_cume_dist
from ratingloom.operators.quantiles import ROWS, grouped_quantiles, value_counts
from ratingloom.sources import schema as S

# fixed values: names of the metrics
METRICS = ["mae", "rmse", "mape", "r_squared", "mean_error_pred_minus_actual", "p90_absolute_error"]
ACTUAL = "actual_co2_g_km"
PREDICTED = "predicted_co2_g_km"
ERROR = "prediction_error_g_km"
ABSOLUTE = "absolute_error_g_km"


def regression_metrics(
    df: DataFrame,
    actual: str = ACTUAL,
    predicted: str = PREDICTED,
    keys: list[str] | tuple = (),
    extra: list[Column] | None = None,
) -> DataFrame:
    """Rows, MAE, RMSE, MAPE, R², mean error and exact P90 of the absolute error per group.

    R² compares the squared errors with the variance of the target, so one pass suffices; it is null
    where the target does not vary.
    """
    keys = list(keys)
    y, guess = F.col(actual).cast("double"), F.col(predicted).cast("double")
    scored = df.withColumns({"__error": guess - y, "__size": F.abs(guess - y)})
    error = F.col("__error")
    squares = F.sum(error * error)
    summary = scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("vehicle_records"),
        *(extra or []),
        F.avg("__size").alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(floored_percentage_error(error, actual)).alias("mape"),
        (F.lit(1.0) - safe_ratio(squares, F.var_pop(y) * F.count(y))).alias("r_squared"),
        F.avg(error).alias("mean_error_pred_minus_actual"),
    )
    tail = grouped_quantiles(scored, "__size", {"p90_absolute_error": 0.9}, keys)
    return join_on_keys(summary, tail, keys) if keys else with_one_row(summary, tail)


def sql_model_metrics(predictions: DataFrame, split: str = "test") -> DataFrame:
    """Metrics recomputed from the stored, rounded errors of one split, per model."""
    rows = predictions.where(F.col("data_split") == split)
    centred = with_one_row(rows, rows.agg(F.avg(F.col(ACTUAL).cast("double")).alias("mean_actual")))
    error, away = F.col(ERROR).cast("double"), F.col(ACTUAL).cast("double") - F.col("mean_actual")
    return centred.groupBy("model_name").agg(
        F.count(F.lit(1)).alias("test_records"),
        F.avg(F.col(ABSOLUTE).cast("double")).alias("mae"),
        F.sqrt(F.avg(F.pow(error, 2))).alias("rmse"),
        F.avg(F.col("absolute_percentage_error").cast("double")).alias("mape"),
        (F.lit(1.0) - safe_ratio(F.sum(F.pow(error, 2)), F.sum(F.pow(away, 2)))).alias("r_squared"),
    )


def class_residuals(
    predictions: DataFrame, fact: DataFrame, minimum: int = 20, split: str = "test", key: str = "vehicle_id"
) -> DataFrame:
    """Residuals per vehicle class with enough rows, worst class first."""
    rows = predictions.where(F.col("data_split") == split).select(key, ERROR, ABSOLUTE)
    joined = join_eval(rows, fact.select(key, "vehicle_class"), key)
    error = F.col(ERROR).cast("double")
    table = joined.groupBy("vehicle_class").agg(
        F.count(F.lit(1)).alias("test_records"),
        decimal_mean(ABSOLUTE, 3).alias("mae"),
        F.sqrt(F.avg(F.pow(error, 2))).alias("rmse"),
        decimal_mean(ERROR, 3).alias("mean_error_pred_minus_actual"),
    )
    return table.where(F.col("test_records") >= minimum).orderBy(*order_columns(["-mae", "vehicle_class"]))


def worst_share(
    predictions: DataFrame,
    value: str = ABSOLUTE,
    cut: float = 0.90,
    name: str = "error_percentile",
) -> DataFrame:
    """Rows whose CUME_DIST reaches the cut, ties included, with that share.

    Shares come from counted distinct values. The smallest value of the tail filters the rows before
    they are joined, so only the tail moves.
    """
    shares = with_cume_dist(value_counts(predictions, value), value, ROWS, name=name)
    tail = shares.where(F.col(name) >= cut).select(value, name)
    threshold = tail.agg(F.min(value).alias("smallest")).scalar()
    return predictions.where(F.col(value) >= threshold).join(tail, value)


def worst_errors(predictions: DataFrame, detail: DataFrame, cut: float = 0.90, split: str = "test") -> DataFrame:
    """The largest errors of a split with the facts they belong to."""
    tail = worst_share(predictions.where(F.col("data_split") == split), cut=cut)
    facts = detail.select(
        "vehicle_id", "model_year", "make", "model", "vehicle_class", "engine_size_l", "cylinders", "fuel_type"
    )
    errors = tail.select("vehicle_id", ACTUAL, PREDICTED, ERROR, ABSOLUTE, "error_percentile")
    return join_eval(errors, facts, "vehicle_id").orderBy(*order_columns([f"-{ABSOLUTE}", "vehicle_id"]))


# fixed values: labels of the segments
SEGMENTS = {
    "Model Year": "model_year",
    "Vehicle Class": "vehicle_class",
    "Fuel Type": "fuel_type",
    "Engine Size Band": "engine_size_band",
}


def segment_errors(
    test: DataFrame,
    segments: dict[str, str] | None = None,
    actual: str = ACTUAL,
    predicted: str = PREDICTED,
) -> DataFrame:
    """The metric set of several independent groupings, stacked, from one scan and one grouping."""
    chosen = segments or SEGMENTS
    labelled = test.select(
        actual, predicted, *[F.col(source).cast("string").alias(label) for label, source in chosen.items()]
    )
    stacked = labelled.unpivot([actual, predicted], list(chosen), "segment_type", "segment_value")
    means = [
        F.avg(F.col(actual).cast("double")).alias("average_actual_co2_g_km"),
        F.avg(F.col(predicted).cast("double")).alias("average_predicted_co2_g_km"),
    ]
    known = stacked.where(F.col("segment_value").isNotNull())
    return regression_metrics(known, actual, predicted, ["segment_type", "segment_value"], means)


def split_summary(
    df: DataFrame, target: str, train_until: int = S.TRAIN_UNTIL, validate_until: int = S.VALIDATE_UNTIL
) -> DataFrame:
    """Rows, period range and mean target of train, validation, development and test.

    Development overlaps train and validation, so a row carries every label it belongs to.
    """
    year = F.col("model_year")
    labels = F.array_compact(
        F.array(
            F.when(year <= train_until, F.lit("train")),
            F.when((year > train_until) & (year <= validate_until), F.lit("validation")),
            F.when(year <= validate_until, F.lit("development")),
            F.when(year > validate_until, F.lit("test")),
        )
    )
    labelled = df.select("model_year", F.col(target).alias("__target"), F.explode(labels).alias("split"))
    return labelled.groupBy("split").agg(
        F.count(F.lit(1)).alias("vehicle_records"),
        F.min("model_year").alias("first_model_year"),
        F.max("model_year").alias("latest_model_year"),
        (F.sum(F.col("__target").cast("decimal(18,3)")).cast("double") / F.count("__target")).alias("average_target"),
    )


def high_error_flag(
    scored: DataFrame, split: str = "test", q: float = 0.9, value: str = ABSOLUTE, name: str = "high_error_flag"
) -> DataFrame:
    """Flag every row whose error reaches the quantile of one split, the other splits included."""
    reference = scored.where(F.col("data_split") == split)
    threshold = grouped_quantiles(reference, value, {"threshold": q}).scalar()
    return scored.withColumn(name, flag(F.col(value).cast("double") >= threshold))


def error_columns(
    df: DataFrame,
    raw_prediction: str,
    actual: str = ACTUAL,
    edges: list[float] | None = None,
    labels: list[str] | None = None,
) -> DataFrame:
    """Rounded prediction, error, absolute and relative error and predicted band of scored rows."""
    rounded = half_even(raw_prediction, 3).cast("decimal(18,3)")
    with_error = df.withColumn(PREDICTED, rounded).withColumn(
        ERROR, (F.col(PREDICTED) - F.col(actual).cast("decimal(18,3)")).cast("decimal(18,3)")
    )
    absolute = with_error.withColumn(ABSOLUTE, F.abs(ERROR))
    relative = safe_ratio(F.col(ABSOLUTE).cast("double"), F.col(actual).cast("double"))
    return absolute.withColumns(
        {
            "absolute_percentage_error": half_even(relative, 6),
            "predicted_emission_band": bucketize(
                PREDICTED, edges or S.EMISSION_EDGES, labels or S.EMISSION_LABELS, right=False
            ),
        }
    )


def scored_errors(
    df: DataFrame, model_name: str, raw_prediction: str, target: str, split: str = "model_split"
) -> DataFrame:
    """Scored rows with their errors and band, row by row."""
    named = df.withColumnsRenamed({target: ACTUAL, split: "data_split"}).withColumn("model_name", F.lit(model_name))
    return error_columns(named, raw_prediction)


def score_rows(
    df: DataFrame, model_name: str, raw_prediction: str, target: str, split: str = "model_split"
) -> DataFrame:
    """The predictions table: every row scored, its errors, band and high-error flag."""
    return high_error_flag(scored_errors(df, model_name, raw_prediction, target, split))


# fixed values: columns of the prediction table
PREDICTION_COLUMNS = [
    "vehicle_id",
    "data_split",
    "model_name",
    ACTUAL,
    PREDICTED,
    ERROR,
    ABSOLUTE,
    "absolute_percentage_error",
    "predicted_emission_band",
    "high_error_flag",
]


def prediction_range(predictions: DataFrame, split: str = "test") -> DataFrame:
    """Range of the predictions of one split and the bounds a square plot of it needs."""
    rows = predictions.where(F.col("data_split") == split)
    return rows.agg(
        F.min(PREDICTED).alias("minimum"),
        F.max(PREDICTED).alias("maximum"),
        F.least(F.min(F.col(ACTUAL).cast("double")), F.min(F.col(PREDICTED).cast("double"))).alias("axis_low"),
        F.greatest(F.max(F.col(ACTUAL).cast("double")), F.max(F.col(PREDICTED).cast("double"))).alias("axis_high"),
    )


def metric_row(
    scored: DataFrame,
    model_name: str,
    scope: str,
    split: str,
    eligible: bool,
    fit_period: str,
    actual: str = ACTUAL,
    predicted: str = PREDICTED,
) -> DataFrame:
    """The metric set of one evaluation with the labels that identify it."""
    return regression_metrics(scored, actual, predicted).select(
        F.lit(model_name).alias("model_name"),
        F.lit(scope).alias("model_scope"),
        F.lit(split).alias("split"),
        F.lit(int(eligible)).alias("eligible_for_selection"),
        F.lit(fit_period).alias("fit_period"),
        *METRICS,
    )


def stack(*frames: DataFrame) -> DataFrame:
    """Rows of all frames under the first one's column order."""
    first, *others = frames
    for other in others:
        first = first.unionByName(other)
    return first


def metrics_ledger(rows: list[DataFrame]) -> DataFrame:
    """Metric rows numbered in the order they were produced."""
    return stack(*[row.withColumn("metric_id", F.lit(i)) for i, row in enumerate(rows, start=1)]).select(
        "metric_id", "model_name", "model_scope", "split", "eligible_for_selection", "fit_period", *METRICS
    )


def select_best(metrics: DataFrame, tie: str = "metric_id") -> DataFrame:
    """The row with the smallest MAE, then RMSE, then identifier."""
    return top_n(metrics, ["mae", "rmse", tie], 1)


def selected_metric(metrics: DataFrame, scope: str = "early_specification", split: str = "test") -> DataFrame:
    """The eligible metric row of a scope and split; the smallest identifier if several qualify."""
    eligible = metrics.where(
        (F.col("model_scope") == scope) & (F.col("split") == split) & (F.col("eligible_for_selection") == 1)
    )
    return top_n(eligible, ["metric_id"], 1)


def importance_rank(importance: DataFrame) -> DataFrame:
    """Features ranked by mean error increase within each model.

    The frame is read once: a mean of doubles that is computed again may differ in its last digit, so ranks must not be
    joined back by it.
    """
    return summary_rank(importance, ["-importance_mean_mae_increase"], ["model_name"], "importance_rank")


def model_metadata(
    ledger: DataFrame, splits: DataFrame, predicted: DataFrame, features: list[str], excluded: list[str], target: str,
    parameters: dict | None = None,
) -> DataFrame:
    """What a training stage leaves behind, as one row: the selected model with its parameters, what it saw and what was
    withheld from it, rows and years of each split, its test metrics and the range of its test predictions."""
    chosen = selected_metric(ledger)
    named = [F.lit(n) for n in sorted(excluded)]
    parts = splits.agg(F.sort_array(F.collect_list(F.struct(*splits.columns)))).scalar()
    span = prediction_range(predicted).select(F.struct("minimum", "maximum")).scalar()
    settings = {k: v for k, v in (parameters or {}).items() if v is not None}
    return chosen.select(
        "model_name",
        "model_scope",
        "fit_period",
        F.lit(target).alias("target"),
        F.lit(json.dumps(settings, sort_keys=True)).alias("parameters"),
        F.array(*[F.lit(n) for n in features]).alias("features"),
        F.array(*named).alias("excluded_columns"),
        parts.alias("splits"),
        *[F.col(m).alias(f"test_{m}") for m in METRICS],
        span.alias("prediction_range"),
    )
