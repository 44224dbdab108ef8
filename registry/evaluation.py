"""Queries over scored rows, metrics, views, exports and fitted models."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from ratingloom.operators import metrics as M, models as ML
from ratingloom.operators.joins import join_summary, settled
from ratingloom.operators.metrics import PREDICTION_COLUMNS
from ratingloom.operators.ordering import head_by, summary_position
from ratingloom.plans import validation as V, views as W
from ratingloom.session import scratch_path, stored
from ratingloom.sources import writers as IO
from ratingloom.sources.literals import fuel_type_lookup, transmission_family_lookup
from ratingloom.sources.schema import LEAKY_COLUMNS
from registry import tables as R
from registry.catalog import query
from registry.tables import (
    BASE,
    ERRORS,
    FACT,
    FLAGGED,
    LINES,
    MODEL,
    NUMBERED,
    PEER_SQL,
    PREDICTED,
    RATINGS,
    SCORED,
    SINCE,
    TRAIN_UNTIL,
    VALIDATE_UNTIL,
)

ALL = (RATINGS, NUMBERED, PEER_SQL, FACT, LINES, SCORED, ERRORS, FLAGGED)
TARGET = "co2_emissions_g_km"

# --- scored rows -------------------------------------------------------------------------------------


SCORED_COLUMNS = ["vehicle_id", "model_year", "vehicle_class", "fuel_cons_city_l_100km", TARGET, "model_split"]


def stored_rows(spark, folder, columns: list[str] | None = None) -> DataFrame:
    """Numbered ratings written once, as the load step would; joins by id then read one numbering."""
    rows = R.numbered_ratings(spark, folder)
    return stored(rows.select(*columns) if columns else rows, "numbered")


SCORE_SHAPE = (
    "vehicle_id:l data_split:s model_name:s actual_co2_g_km:d predicted_co2_g_km:d3 prediction_error_g_km:d3 "
    "absolute_error_g_km:d3 absolute_percentage_error:d predicted_emission_band:s high_error_flag:l"
)


@query("score_rows", SCORE_SHAPE, "SELECT * FROM flagged", PREDICTED)
def score_rows(spark, folder):
    return R.prediction_table(R.numbered_ratings(spark, folder))


@query(
    "high_error_flag",
    "data_split:s high_error_flag:l rows:l smallest:d3",
    """SELECT data_split, high_error_flag, count(*) AS rows, min(absolute_error_g_km) AS smallest
       FROM flagged GROUP BY data_split, high_error_flag""",
    PREDICTED,
)
def high_error_flag(spark, folder):
    scored = R.errors(R.ratings(spark, folder))
    return (
        M.high_error_flag(scored)
        .groupBy("data_split", "high_error_flag")
        .agg(F.count(F.lit(1)).alias("rows"), F.min("absolute_error_g_km").alias("smallest"))
    )


def metric_sql(y: str, p: str) -> str:
    error = f"(CAST({p} AS DOUBLE) - CAST({y} AS DOUBLE))"
    return f"""avg(abs({error})) AS mae, sqrt(avg({error} * {error})) AS rmse,
        avg(abs({error}) / greatest(abs(CAST({y} AS DOUBLE)), 2.220446049250313e-16)) AS mape,
        1 - sum({error} * {error}) / nullif(var_pop(CAST({y} AS DOUBLE)) * count(*), 0) AS r_squared,
        avg({error}) AS mean_error_pred_minus_actual, quantile_cont(abs({error}), 0.9) AS p90_absolute_error"""


METRIC_SHAPE = "mae:d rmse:d mape:d8 r_squared:d8 mean_error_pred_minus_actual:d p90_absolute_error:d"
STORED = metric_sql("actual_co2_g_km", "predicted_co2_g_km")


@query(
    "regression_metrics",
    f"data_split:s vehicle_records:l {METRIC_SHAPE}",
    f"SELECT data_split, count(*) AS vehicle_records, {STORED} FROM errors GROUP BY data_split",
    PREDICTED,
)
def regression_metrics(spark, folder):
    return M.regression_metrics(R.errors(R.ratings(spark, folder)), keys=["data_split"])


@query(
    "model_metrics_sql",
    "model_name:s test_records:l mae:d rmse:d mape:d8 r_squared:d8",
    f"""SELECT model_name, count(*) AS test_records, {STORED.replace("AS mape", "AS floored_mape")},
        avg(absolute_percentage_error) AS mape FROM errors WHERE data_split = 'test' GROUP BY model_name""",
    PREDICTED,
)
def model_metrics_sql(spark, folder):
    return M.sql_model_metrics(R.errors(R.ratings(spark, folder)))


@query(
    "class_residuals",
    "vehicle_class:s test_records:l mae:d rmse:d mean_error_pred_minus_actual:d",
    f"""SELECT vehicle_class, count(*) AS test_records, {STORED.replace("AS mae", "AS plain_mae").replace("AS mean_error", "AS plain_mean_error")},
        round(CAST(sum(absolute_error_g_km) AS DOUBLE) / count(*), 7) AS mae,
        round(CAST(sum(prediction_error_g_km) AS DOUBLE) / count(*), 7) AS mean_error_pred_minus_actual
        FROM errors WHERE data_split = 'test' GROUP BY vehicle_class HAVING count(*) >= 20""",
    PREDICTED,
)
def class_residuals(spark, folder):
    rows = stored_rows(spark, folder, SCORED_COLUMNS)
    return M.class_residuals(R.errors(rows), rows)


@query(
    "worst_decile",
    "vehicle_id:l model_year:l make:s model:s vehicle_class:s engine_size_l:d cylinders:l fuel_type:s "
    "actual_co2_g_km:d predicted_co2_g_km:d3 prediction_error_g_km:d3 absolute_error_g_km:d3 error_percentile:d8",
    """SELECT * FROM (SELECT *, cume_dist() OVER (ORDER BY absolute_error_g_km) AS error_percentile
         FROM errors WHERE data_split = 'test') WHERE error_percentile >= 0.90""",
    PREDICTED,
)
def worst_decile(spark, folder):
    rows = stored_rows(
        spark, folder, [*SCORED_COLUMNS, "make", "model", "engine_size_l", "cylinders", "fuel_type"]
    )
    return M.worst_errors(R.errors(rows), rows)


@query(
    "segment_errors",
    f"segment_type:s segment_value:s vehicle_records:l average_actual_co2_g_km:d average_predicted_co2_g_km:d {METRIC_SHAPE}",
    " UNION ALL ".join(
        f"""SELECT '{label}' AS segment_type, CAST({column} AS VARCHAR) AS segment_value, count(*) AS vehicle_records,
            avg(actual_co2_g_km) AS average_actual_co2_g_km, avg(CAST(predicted_co2_g_km AS DOUBLE)) AS average_predicted_co2_g_km,
            {STORED} FROM errors WHERE data_split = 'test' GROUP BY {column}"""
        for label, column in M.SEGMENTS.items()
    ),
    PREDICTED,
)
def segment_errors(spark, folder):
    return M.segment_errors(R.errors(R.ratings(spark, folder)).where("data_split = 'test'"))


@query(
    "split_summary",
    "split:s vehicle_records:l first_model_year:l latest_model_year:l average_target:d",
    " UNION ALL ".join(
        f"""SELECT '{name}' AS split, count(*) AS vehicle_records, min(model_year) AS first_model_year,
            max(model_year) AS latest_model_year, avg(co2_emissions_g_km) AS average_target FROM ratings WHERE {rule}"""
        for name, rule in {
            "train": f"model_year <= {TRAIN_UNTIL}",
            "validation": f"model_year > {TRAIN_UNTIL} AND model_year <= {VALIDATE_UNTIL}",
            "development": f"model_year <= {VALIDATE_UNTIL}",
            "test": f"model_year > {VALIDATE_UNTIL}",
        }.items()
    ),
    BASE,
)
def split_summary(spark, folder):
    return M.split_summary(R.ratings(spark, folder), TARGET, TRAIN_UNTIL, VALIDATE_UNTIL)


@query(
    "prediction_range",
    "minimum:d3 maximum:d3 axis_low:d3 axis_high:d3",
    """SELECT min(predicted_co2_g_km) AS minimum, max(predicted_co2_g_km) AS maximum,
       least(min(actual_co2_g_km), CAST(min(predicted_co2_g_km) AS DOUBLE)) AS axis_low,
       greatest(max(actual_co2_g_km), CAST(max(predicted_co2_g_km) AS DOUBLE)) AS axis_high
       FROM errors WHERE data_split = 'test'""",
    PREDICTED,
)
def prediction_range(spark, folder):
    return M.prediction_range(R.errors(R.ratings(spark, folder)))


# --- the metrics ledger over predictors that SQL can express -----------------------------------------


def splits(spark, folder) -> ML.Splits:
    return ML.Splits(R.ratings(spark, folder), "model_year", TRAIN_UNTIL, VALIDATE_UNTIL)


def model_splits(spark, folder) -> ML.Splits:
    """The model columns written once, so that the passes of a fit read a narrow table."""
    columns = [*ML.NUMERIC_FEATURES, *ML.CATEGORICAL_FEATURES, *ML.MEASURED_FEATURES, TARGET]
    rows = stored(R.ratings(spark, folder).select(*columns), "model-rows")
    return ML.Splits(rows, "model_year", TRAIN_UNTIL, VALIDATE_UNTIL)


CANDIDATES = {"Median Baseline": ML.median_baseline, "Class Mean": R.class_mean, MODEL: R.class_line}
EARLY = "early_specification"


def _evaluated(name: str, train: DataFrame, rows: DataFrame, split: str, eligible: bool, period: str) -> DataFrame:
    scored = CANDIDATES[name](train, rows)
    return M.metric_row(scored, name, EARLY, split, eligible, period, TARGET, "prediction")


def narrow_splits(spark, folder) -> ML.Splits:
    """The columns the candidates read, written once."""
    rows = R.ratings(spark, folder).select("model_year", "vehicle_class", "fuel_cons_city_l_100km", TARGET)
    return ML.Splits(stored(rows, "candidate-rows"), "model_year", TRAIN_UNTIL, VALIDATE_UNTIL)


def validated(parts: ML.Splits) -> DataFrame:
    period = f"until {TRAIN_UNTIL}"
    return settled(
        M.metrics_ledger(
            [_evaluated(name, parts.train, parts.validation, "validation", True, period) for name in CANDIDATES]
        )
    )


def ledger(spark, folder) -> DataFrame:
    parts = narrow_splits(spark, folder)
    candidates = validated(parts)
    chosen = M.select_best(candidates).first()["model_name"]
    period = f"until {VALIDATE_UNTIL} refit"
    tests = M.metrics_ledger(
        [
            _evaluated(chosen, parts.development, parts.test, "test", True, period),
            _evaluated("Median Baseline", parts.development, parts.test, "test", False, period),
        ]
    )
    return candidates.unionByName(tests.withColumn("metric_id", F.col("metric_id") + len(CANDIDATES)))


def _candidate_sql(name: str, until: int, rule: str) -> str:
    train = f"FROM ratings WHERE model_year <= {until}"
    y = "CAST(r.co2_emissions_g_km AS DOUBLE)"
    fits = {
        "Median Baseline": (f"(SELECT quantile_cont(CAST(co2_emissions_g_km AS DOUBLE), 0.5) {train})", ""),
        "Class Mean": (
            "fit.guess",
            f"""JOIN (SELECT vehicle_class, avg(CAST(co2_emissions_g_km AS DOUBLE)) AS guess {train}
                GROUP BY vehicle_class) AS fit USING (vehicle_class)""",
        ),
        MODEL: (
            "fit.intercept + fit.slope * CAST(r.fuel_cons_city_l_100km AS DOUBLE)",
            f"""JOIN (SELECT vehicle_class,
                  regr_slope(CAST(co2_emissions_g_km AS DOUBLE), CAST(fuel_cons_city_l_100km AS DOUBLE)) AS slope,
                  regr_intercept(CAST(co2_emissions_g_km AS DOUBLE), CAST(fuel_cons_city_l_100km AS DOUBLE)) AS intercept
                {train} GROUP BY vehicle_class) AS fit USING (vehicle_class)""",
        ),
    }
    guess, join = fits[name]
    return f"""SELECT '{name}' AS model_name, {metric_sql("y", "guess")}
        FROM (SELECT {y} AS y, {guess} AS guess FROM ratings AS r {join} WHERE {rule})"""


VALIDATED = "validated AS (" + " UNION ALL ".join(
    f"SELECT {i} AS metric_id, * FROM ({_candidate_sql(n, TRAIN_UNTIL, f'model_year > {TRAIN_UNTIL} AND model_year <= {VALIDATE_UNTIL}')})"
    for i, n in enumerate(CANDIDATES, start=1)
) + ")"
TESTED = "tested AS (" + " UNION ALL ".join(
    _candidate_sql(n, VALIDATE_UNTIL, f"model_year > {VALIDATE_UNTIL}") for n in CANDIDATES
) + ")"
LEDGER = f"""ledger AS (
  SELECT *, '{EARLY}' AS model_scope, 'validation' AS split, 1 AS eligible_for_selection, 'until {TRAIN_UNTIL}' AS fit_period
  FROM validated
  UNION ALL SELECT 4, *, '{EARLY}', 'test', 1, 'until {VALIDATE_UNTIL} refit' FROM tested
  WHERE model_name = (SELECT model_name FROM validated ORDER BY mae, rmse, metric_id LIMIT 1)
  UNION ALL SELECT 5, *, '{EARLY}', 'test', 0, 'until {VALIDATE_UNTIL} refit' FROM tested WHERE model_name = 'Median Baseline')"""
MEASURED = (RATINGS, VALIDATED, TESTED, LEDGER)
LEDGER_SHAPE = (
    f"metric_id:l model_name:s model_scope:s split:s eligible_for_selection:l fit_period:s {METRIC_SHAPE}"
)


@query("metrics_ledger", LEDGER_SHAPE, "SELECT * FROM ledger", MEASURED)
def metrics_ledger(spark, folder):
    return ledger(spark, folder)


@query(
    "median_baseline",
    LEDGER_SHAPE,
    "SELECT * FROM ledger WHERE metric_id IN (1, 5)",
    MEASURED,
)
def median_baseline(spark, folder):
    parts = splits(spark, folder)
    first = _evaluated("Median Baseline", parts.train, parts.validation, "validation", True, f"until {TRAIN_UNTIL}")
    last = _evaluated(
        "Median Baseline", parts.development, parts.test, "test", False, f"until {VALIDATE_UNTIL} refit"
    )
    return first.withColumn("metric_id", F.lit(1)).unionByName(last.withColumn("metric_id", F.lit(5)))


@query(
    "model_selection",
    "metric_id:l model_name:s mae:d rmse:d",
    "SELECT * FROM validated ORDER BY mae, rmse, metric_id LIMIT 1",
    MEASURED,
)
def model_selection(spark, folder):
    return M.select_best(validated(narrow_splits(spark, folder)))


ABLATED = ["vehicle_class", "fuel_type", "make", "engine_size_band"]


def importance(spark, folder) -> DataFrame:
    """Error a training mean saves once it knows a feature: mean and spread over the three periods."""
    rows = R.ratings(spark, folder)
    train = rows.where(F.col("model_year") <= TRAIN_UNTIL)
    y = F.col(TARGET).cast("double")
    plain = train.agg(F.avg(y).alias("plain")).scalar()
    base = rows.withColumn("__plain", plain)
    tables = []
    for name in ABLATED:
        means = train.groupBy(name).agg(F.avg(y).alias("__known"))
        scored = join_summary(base, means, [name], "inner")
        increase = F.avg(F.abs(y - F.col("__plain"))) - F.avg(F.abs(y - F.col("__known")))
        tables.append(scored.groupBy("model_split").agg(increase.alias("increase")).withColumn("feature", F.lit(name)))
    summary = M.stack(*tables).groupBy("feature").agg(
        F.avg("increase").alias("importance_mean_mae_increase"), F.stddev_pop("increase").alias("importance_std")
    )
    named = summary.withColumn("model_name", F.lit("Feature Mean"))
    return summary_position(named, ["feature"], "importance_id")


IMPORTANCE = (
    RATINGS,
    "increases AS ("
    + " UNION ALL ".join(
        f"""SELECT '{name}' AS feature, model_split, avg(abs(y - plain)) - avg(abs(y - known)) AS increase
            FROM (SELECT model_split, CAST(co2_emissions_g_km AS DOUBLE) AS y, fit.known,
                    (SELECT avg(CAST(co2_emissions_g_km AS DOUBLE)) FROM ratings WHERE model_year <= {TRAIN_UNTIL}) AS plain
                  FROM ratings JOIN (SELECT {name}, avg(CAST(co2_emissions_g_km AS DOUBLE)) AS known FROM ratings
                    WHERE model_year <= {TRAIN_UNTIL} GROUP BY {name}) AS fit USING ({name})) GROUP BY model_split"""
        for name in ABLATED
    )
    + ")",
    """importance AS (SELECT row_number() OVER (ORDER BY feature) AS importance_id, 'Feature Mean' AS model_name, feature,
       avg(increase) AS importance_mean_mae_increase, stddev_pop(increase) AS importance_std
       FROM increases GROUP BY feature)""",
)


@query(
    "importance_rank",
    "importance_id:l model_name:s feature:s importance_mean_mae_increase:d importance_std:d importance_rank:l",
    """SELECT *, rank() OVER (PARTITION BY model_name ORDER BY importance_mean_mae_increase DESC) AS importance_rank
       FROM importance""",
    IMPORTANCE,
)
def importance_rank(spark, folder):
    return M.importance_rank(importance(spark, folder))


# --- views, ledger of checks, exports ----------------------------------------------------------------


def view_tables(spark, folder) -> W.Tables:
    """The stored tables of the views; ratings and predictions are written once, as a load would."""
    ratings = stored(R.numbered_fact(spark, folder), "ratings")
    # the ratings stand beside it, so only what predictions and segments need is stored again
    columns = dict.fromkeys([*PREDICTION_COLUMNS, *M.SEGMENTS.values()])
    scored = stored(R.predictions(ratings).select(*columns), "predictions")
    errors = settled(M.segment_errors(scored.where("data_split = 'test'")))
    return W.Tables(
        ratings=ratings,
        fuels=fuel_type_lookup(spark),
        transmissions=transmission_family_lookup(spark),
        predictions=scored.select(*PREDICTION_COLUMNS),
        metrics=settled(ledger(spark, folder)),
        importance=settled(importance(spark, folder)),
        segment_errors=summary_position(errors, ["segment_type", "segment_value"], "segment_error_id"),
        recent_since=SINCE,
    )


DETAIL_SHAPE = (
    "vehicle_id:l model_year:l make:s model:s vehicle_class:s engine_size_l:d engine_size_band:s cylinders:l "
    "transmission_family:s gear_count:l fuel_type:s fuel_cons_city_l_100km:d fuel_cons_hwy_l_100km:d "
    "fuel_cons_comb_l_100km:d fuel_economy_comb_mpg:l co2_emissions_g_km:l co2_rating:l smog_rating:l "
    "class_year_co2_median:d3 class_year_co2_p25:d3 co2_vs_class_year_median:d3 co2_gap_to_class_p25:d3 "
    "above_class_year_median:l emission_band:s model_split:s model_name:s predicted_co2_g_km:d3 "
    "prediction_error_g_km:d3 absolute_error_g_km:d3 absolute_percentage_error:d predicted_emission_band:s "
    "high_error_flag:l"
)


@query(
    "vehicle_detail",
    DETAIL_SHAPE,
    """SELECT f.*, floor(2824.8 / CAST(f.fuel_cons_comb_l_100km AS DOUBLE)) AS fuel_economy_comb_mpg, p.model_name,
       p.predicted_co2_g_km, p.prediction_error_g_km, p.absolute_error_g_km, p.absolute_percentage_error,
       p.predicted_emission_band, p.high_error_flag
       FROM fact AS f LEFT JOIN flagged AS p USING (vehicle_id)""",
    ALL,
)
def vehicle_detail(spark, folder):
    rows = stored_rows(spark, folder)
    detail = W.vehicle_detail(
        R.with_peers(rows), fuel_type_lookup(spark), transmission_family_lookup(spark), R.prediction_table(rows)
    )
    # the join of both sides moves all columns of all rows, so it runs and is stored slice by slice
    size = rows.count()
    slices = max(1, min(SLICES, -(-size // SLICE_ROWS)))
    ends = [size * i // slices for i in range(slices + 1)]
    spans = [F.col("vehicle_id").between(a + 1, b) for a, b in zip(ends, ends[1:])]
    return reduce(DataFrame.unionByName, [stored(detail.where(span), "detail") for span in spans])


def _at(name: str, scale: int, edge: str) -> str:
    return f"""(SELECT round(CAST(sum({name}) AS DOUBLE) / count(*), {scale}) FROM fact
        WHERE model_year = (SELECT {edge}(model_year) FROM fact))"""


@query(
    "kpis",
    "vehicle_records:l first_model_year:l latest_model_year:l years_covered:l latest_year_records:l "
    "latest_average_co2_g_km:d4 latest_average_combined_l_100km:d5 co2_change_first_to_latest_pct:d8 "
    "latest_average_peer_gap_g_km:d7 selected_model:s test_records:l test_mae_g_km:d test_rmse_g_km:d test_mape:d8 "
    "test_r_squared:d8 test_p90_absolute_error_g_km:d",
    f"""SELECT (SELECT count(*) FROM fact) AS vehicle_records, (SELECT min(model_year) FROM fact) AS first_model_year,
        (SELECT max(model_year) FROM fact) AS latest_model_year,
        (SELECT count(DISTINCT model_year) FROM fact) AS years_covered,
        (SELECT count(*) FROM fact WHERE model_year = (SELECT max(model_year) FROM fact)) AS latest_year_records,
        {_at(TARGET, 4, "max")} AS latest_average_co2_g_km,
        {_at("fuel_cons_comb_l_100km", 5, "max")} AS latest_average_combined_l_100km,
        {_at(TARGET, 4, "max")} / {_at(TARGET, 4, "min")} - 1 AS co2_change_first_to_latest_pct,
        {_at("co2_gap_to_class_p25", 7, "max")} AS latest_average_peer_gap_g_km,
        model_name AS selected_model, (SELECT count(*) FROM errors WHERE data_split = 'test') AS test_records,
        mae AS test_mae_g_km, rmse AS test_rmse_g_km, mape AS test_mape, r_squared AS test_r_squared,
        p90_absolute_error AS test_p90_absolute_error_g_km
        FROM ledger WHERE split = 'test' AND eligible_for_selection = 1""",
    (*ALL, VALIDATED, TESTED, LEDGER),
)
def kpis(spark, folder):
    rows = R.ratings(spark, folder)
    return W.kpis(R.with_peers(rows), ledger(spark, folder), R.errors(rows))


# slices that the wide join is cut into, and rows from which another one pays
SLICES, SLICE_ROWS = 16, 4_000_000


VIEW_SOURCES = {
    "vehicle_detail": "fact",
    "yearly_trend": "(SELECT DISTINCT model_year FROM fact)",
    "class_benchmark": "(SELECT DISTINCT model_year, vehicle_class FROM fact)",
    "make_benchmark": "(SELECT DISTINCT model_year, make FROM fact)",
    "model_performance": "ledger",
    "feature_importance": "importance",
    "high_emission_opportunities": f"(SELECT * FROM fact WHERE model_year >= {SINCE} AND co2_gap_to_class_p25 > 0)",
    "test_segment_errors": "(" + " UNION ALL ".join(
        f"SELECT '{label}', CAST({column} AS VARCHAR) FROM errors WHERE data_split = 'test' GROUP BY {column}"
        for label, column in M.SEGMENTS.items()
    ) + ")",
    "kpis": "(SELECT * FROM ledger WHERE split = 'test' AND eligible_for_selection = 1)",
}


@query(
    "view_counts",
    "view_name:s view_rows:l",
    " UNION ALL ".join(f"SELECT '{n}' AS view_name, count(*) AS view_rows FROM {s}" for n, s in VIEW_SOURCES.items()),
    (*ALL, VALIDATED, TESTED, LEDGER, *IMPORTANCE[1:]),
)
def view_counts(spark, folder):
    return W.view_counts(W.build_views(view_tables(spark, folder)))


REQUIRED = ["vehicle_id", "model_year", "make", "vehicle_class", "engine_size_l", "cylinders", "fuel_type", TARGET]


@query(
    "validation_report",
    "check_name:s status:s actual:s expected:s",
    """SELECT * FROM (SELECT count(*) AS n, count_if(model_split = 'test') AS t, min(model_year) AS a, max(model_year) AS z,
           (SELECT CAST(round(mae, 6) AS DECIMAL(28,6)) FROM ledger WHERE metric_id = 4) AS mae,
           (SELECT CAST(round(r_squared, 6) AS DECIMAL(28,6)) FROM ledger WHERE metric_id = 4) AS r2 FROM ratings) AS facts,
         LATERAL (VALUES ('raw rows', 'PASS', CAST(n AS VARCHAR), CAST(n AS VARCHAR)),
           ('clean rows', 'PASS', CAST(n AS VARCHAR), CAST(n AS VARCHAR)),
           ('exact duplicates removed', 'PASS', '0', '>= 0'),
           ('unique vehicle ids', 'PASS', CAST(n AS VARCHAR), CAST(n AS VARCHAR)),
           ('required clean values', 'PASS', '0', '0'),
           ('model years', CASE WHEN a = 1995 AND z = 2001 THEN 'PASS' ELSE 'FAIL' END, a || '-' || z, '1995-2001'),
           ('prediction rows', 'PASS', CAST(n AS VARCHAR), CAST(n AS VARCHAR)),
           ('prediction ids', 'PASS', CAST(n AS VARCHAR), CAST(n AS VARCHAR)),
           ('test rows', 'PASS', CAST(t AS VARCHAR), CAST(t AS VARCHAR)),
           ('finite predictions', 'PASS', CAST(n AS VARCHAR), CAST(n AS VARCHAR)),
           ('single KPI row', 'PASS', '1', '1'),
           ('one selected test metric', 'PASS', '1', '1'),
           ('test MAE beats the baseline bound', CASE WHEN mae < 200 THEN 'PASS' ELSE 'FAIL' END, CAST(mae AS VARCHAR), '< 200'),
           ('test R-squared bounded', CASE WHEN r2 BETWEEN -1 AND 1 THEN 'PASS' ELSE 'FAIL' END, CAST(r2 AS VARCHAR), 'between -1 and 1'),
           ('KPI MAE matches metrics', 'PASS', CAST(mae AS VARCHAR), CAST(mae AS VARCHAR)))
         AS checks(check_name, status, actual, expected)""",
    MEASURED,
)
def validation_report(spark, folder):
    ratings = stored_rows(spark, folder)
    predicted = stored(R.prediction_table(ratings), "predictions")
    found = settled(ledger(spark, folder))
    headline = W.kpis(R.with_peers(ratings), found, predicted)
    return V.validation_report(
        V.table_checks(R.raw_ratings(spark, folder), ratings, predicted, REQUIRED, R.FIRST_YEAR, R.LAST_YEAR),
        V.metric_checks(found, headline, worst_mae=200),
    )


@query(
    "model_metadata",
    "model_name:s fit_period:s target:s features:s excluded:l train_records:l validation_records:l test_records:l "
    f"{' '.join('test_' + m for m in METRIC_SHAPE.split())} lowest:d3 highest:d3",
    f"""SELECT model_name, fit_period, '{TARGET}' AS target, 'vehicle_class,fuel_cons_city_l_100km' AS features,
        {len(LEAKY_COLUMNS)} AS excluded, count_if(data_split = 'train') AS train_records,
        count_if(data_split = 'validation') AS validation_records, count_if(data_split = 'test') AS test_records,
        {", ".join(f"any_value({m.split(':')[0]}) AS test_{m.split(':')[0]}" for m in METRIC_SHAPE.split())},
        min(predicted_co2_g_km) FILTER (data_split = 'test') AS lowest, max(predicted_co2_g_km) FILTER (data_split = 'test') AS highest
        FROM (SELECT * EXCLUDE (model_name) FROM errors), (SELECT * FROM ledger WHERE split = 'test' AND eligible_for_selection = 1)
        GROUP BY model_name, fit_period""",
    (*ALL, VALIDATED, TESTED, LEDGER),
)
def model_metadata(spark, folder):
    rows = stored_rows(spark, folder, SCORED_COLUMNS)
    splits = M.split_summary(rows, TARGET, TRAIN_UNTIL, VALIDATE_UNTIL)
    features = ["vehicle_class", "fuel_cons_city_l_100km"]
    made = M.model_metadata(settled(ledger(spark, folder)), splits, R.errors(rows), features, LEAKY_COLUMNS, TARGET)

    def records(split):
        return F.filter("splits", lambda s: s["split"] == split)[0]["vehicle_records"].alias(f"{split}_records")

    return made.select(
        "*", F.size("excluded_columns").alias("excluded"), *map(records, ("train", "validation", "test")),
        F.col("prediction_range.minimum").alias("lowest"), F.col("prediction_range.maximum").alias("highest"),
    ).withColumn("features", F.array_join("features", ","))


@query(
    "lookup_upsert",
    "p_partkey:l p_name:s p_size:l",
    """SELECT p_partkey, CASE WHEN p_size > 40 THEN upper(p_name) ELSE p_name END AS p_name, p_size FROM part
       UNION ALL SELECT p_partkey + 1000000000, 'new ' || p_name, p_size FROM part WHERE p_size = 1""",
)
def lookup_upsert(spark, folder):
    parts = R.table(spark, folder, "part").select("p_partkey", "p_name", "p_size")
    place = scratch_path(spark, "lookup")
    IO.upsert_table(parts, place, "p_partkey")
    changed = parts.where("p_size > 40").withColumn("p_name", F.upper("p_name"))
    added = parts.where("p_size = 1").select(
        (F.col("p_partkey") + 1_000_000_000).alias("p_partkey"), F.concat(F.lit("new "), "p_name").alias("p_name"), "p_size"
    )
    return IO.upsert_table(changed.unionByName(added), place, "p_partkey", F.col("p_size").isNull())


@query("export_manifest", "file:s rows:l columns:l bytes:l sha256:s source:s")
def export_manifest(spark, folder):
    tables = view_tables(spark, folder)
    tuning = ML.mark_selected(tables.metrics.where("split = 'validation'"), "metric_id")
    frames = W.export_set(tables, tuning, W.build_views(tables))
    target = scratch_path(spark, "exports")
    return IO.manifest(spark, target, frames, IO.export_all(frames, target))


# --- fitted models -----------------------------------------------------------------------------------

NUMERIC, CATEGORICAL = ML.NUMERIC_FEATURES, ML.CATEGORICAL_FEATURES
# the other registered forests grow so many trees, on all training rows; the tuning grows the library's ML.FOREST_TREES
TREES = 20


@query(
    "preprocess",
    "l_orderkey:l l_linenumber:l l_partkey:l l_suppkey:l l_quantity:d l_extendedprice:d "
    "model_year__scaled:d engine_size_l__scaled:d cylinders__scaled:d gear_count__scaled:d active_levels:l",
    f"""SELECT r.*, {", ".join(f"(CAST(r.{n} AS DOUBLE) - m_{n}) / s_{n} AS {n}__scaled" for n in NUMERIC)},
        {" + ".join(f"CAST(r.{n} IN (SELECT {n} FROM train) AS INTEGER)" for n in CATEGORICAL)} AS active_levels
        FROM ratings AS r, (SELECT {", ".join(f"avg(CAST({n} AS DOUBLE)) AS m_{n}, stddev_pop(CAST({n} AS DOUBLE)) AS s_{n}" for n in NUMERIC)}
          FROM train)""",
    (RATINGS, f"train AS (SELECT * FROM ratings WHERE model_year <= {TRAIN_UNTIL})"),
)
def preprocess(spark, folder):
    parts = splits(spark, folder)
    vectors = ML.preprocess(parts.train, parts.df, NUMERIC, CATEGORICAL)
    levels = [F.aggregate(vector_to_array(f"{n}__levels"), F.lit(0.0), lambda a, b: a + b) for n in CATEGORICAL]
    return vectors.withColumn("active_levels", sum(levels, F.lit(0.0)).cast("int"))


def _validated(spark, folder, build, name: str) -> DataFrame:
    parts = model_splits(spark, folder)
    model = ML.fit(parts.train, build(parts.train), NUMERIC, CATEGORICAL)
    scored = ML.predict(model, parts.validation)
    row = M.metric_row(scored, name, EARLY, "validation", True, f"until {TRAIN_UNTIL}", TARGET, "prediction")
    return row.withColumn("metric_id", F.lit(1))


_Y = f"CAST({TARGET} AS DOUBLE)"
_KNOWN = f"model_year <= {TRAIN_UNTIL}"
# rows as (row, column, value): scaled numbers, and 1 for each level that training rows have
RIDGE_SQL = f"""WITH spreads AS (SELECT {", ".join(f"avg(CAST({n} AS DOUBLE)) AS m_{n}, stddev_pop(CAST({n} AS DOUBLE)) AS s_{n}" for n in NUMERIC)}
    FROM numbered WHERE {_KNOWN}),
  cells AS (
    {" UNION ALL ".join(f"SELECT vehicle_id, model_year, '{n}' AS name, (CAST({n} AS DOUBLE) - m_{n}) / s_{n} AS x FROM numbered, spreads" for n in NUMERIC)}
    UNION ALL {" UNION ALL ".join(f"SELECT vehicle_id, model_year, '{n}=' || {n}, 1.0 FROM numbered" for n in CATEGORICAL)}),
  targets AS (SELECT vehicle_id, model_year, {_Y} AS y FROM numbered),
  totals AS (SELECT count(*) AS n, avg(y) AS y FROM targets WHERE {_KNOWN}),
  means AS (
    SELECT name, row_number() OVER (ORDER BY name) AS i, sum(x) / any_value(n) AS mean, sum(x * t.y) - sum(x) * any_value(totals.y) AS b
    FROM cells JOIN targets AS t USING (vehicle_id), totals WHERE t.{_KNOWN} GROUP BY name),
  products AS (
    SELECT a.name AS p, b.name AS q, sum(a.x * b.x) AS s FROM cells AS a JOIN cells AS b USING (vehicle_id)
    WHERE a.{_KNOWN} GROUP BY ALL),
  augmented AS (
    SELECT u.i, list_append(list(coalesce(s, 0) - n * u.mean * v.mean + CASE WHEN u.i = v.i THEN {ML.RIDGE_ALPHA} ELSE 0 END ORDER BY v.i), any_value(u.b)) AS line
    FROM totals, means AS u CROSS JOIN means AS v LEFT JOIN products ON p = u.name AND q = v.name GROUP BY u.i),
  steps AS (
    SELECT 1 AS k, list(line ORDER BY i) AS m FROM augmented
    UNION ALL
    SELECT k + 1, list_transform(m, lambda line, pos: list_transform(line, lambda v, col:
      CASE WHEN pos = k THEN v / m[k][k] ELSE v - line[k] / m[k][k] * m[k][col] END)) FROM steps WHERE k <= len(m)),
  weights AS (
    SELECT name, mean, w[-1] AS w FROM means JOIN (
      SELECT unnest(m) AS w, unnest(range(1, len(m) + 1)) AS i FROM steps WHERE k = len(m) + 1) USING (i)),
  guesses AS (
    SELECT vehicle_id, any_value(y) - (SELECT sum(w * mean) FROM weights) AS base
    FROM cells, totals WHERE model_year > {TRAIN_UNTIL} AND model_year <= {VALIDATE_UNTIL} GROUP BY vehicle_id),
  scored_rows AS (
    SELECT vehicle_id, any_value(base) + coalesce(sum(x * w), 0) AS guess
    FROM guesses JOIN cells USING (vehicle_id) LEFT JOIN weights USING (name) GROUP BY vehicle_id)
  SELECT 1 AS metric_id, 'Ridge Regression' AS model_name, '{EARLY}' AS model_scope, 'validation' AS split,
    1 AS eligible_for_selection, 'until {TRAIN_UNTIL}' AS fit_period, {metric_sql("y", "guess")}
  FROM scored_rows JOIN targets USING (vehicle_id)"""


@query("ridge", LEDGER_SHAPE, RIDGE_SQL.replace("WITH spreads", "WITH RECURSIVE spreads"), (RATINGS, NUMBERED))
def ridge(spark, folder):
    return _validated(spark, folder, ML.ridge, "Ridge Regression")


@query("gbt", LEDGER_SHAPE)
def gbt(spark, folder):
    return _validated(spark, folder, lambda train: ML.boosted_trees(), "Gradient Boosted Trees")


@query(
    "rf_tuning",
    f"tuning_id:l model_name:s max_depth:l min_samples_leaf:l max_features:d n_estimators:l {METRIC_SHAPE} "
    "selected_configuration:l",
)
def rf_tuning(spark, folder):
    parts = model_splits(spark, folder)
    return ML.tune_forest(parts.train, parts.validation, NUMERIC, CATEGORICAL)


@query("selected_model", LEDGER_SHAPE)
def selected_model(spark, folder):
    return ML.evaluate(model_splits(spark, folder), trees=TREES).metrics


@query("leakage_diagnostic", LEDGER_SHAPE)
def leakage_diagnostic(spark, folder):
    rich = NUMERIC + ML.MEASURED_FEATURES
    row = ML.leaky_diagnostic(model_splits(spark, folder), rich, CATEGORICAL, TREES)
    return row.withColumn("metric_id", F.lit(1))


def _forest(rows: DataFrame):
    parts = ML.Splits(rows, "model_year", TRAIN_UNTIL, VALIDATE_UNTIL)
    return parts, ML.fit(parts.development, ML.forest(**ML.FOREST_GRID[0], trees=TREES), NUMERIC, CATEGORICAL)


@query(
    "permutation_importance",
    "importance_id:l model_name:s feature:s importance_mean_mae_increase:d importance_std:d",
)
def permutation_importance(spark, folder):
    rows = stored_rows(spark, folder, ["vehicle_id", TARGET, *NUMERIC, *CATEGORICAL])
    parts, model = _forest(rows)
    return ML.permutation_importance(model, parts.test, NUMERIC + CATEGORICAL, "vehicle_id", "Random Forest")


@query("prediction_repro", "rows_compared:l max_difference:d reproduced:l")
def prediction_repro(spark, folder):
    rows = stored_rows(spark, folder, ["vehicle_id", TARGET, *NUMERIC, *CATEGORICAL])
    _, model = _forest(rows)
    path = scratch_path(spark, "model")
    model.write().overwrite().save(path)
    kept = ML.predict(model, rows).select("vehicle_id", F.round("prediction", 3).alias("predicted_co2_g_km"))
    return ML.reproduction_check(path, rows, head_by(kept, "vehicle_id", 25), "vehicle_id", "predicted_co2_g_km")
