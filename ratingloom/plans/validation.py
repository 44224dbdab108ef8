"""The validation ledger: named checks with status, actual and expected value, and their summary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ratingloom.functions.numeric import is_finite
from ratingloom.operators.joins import with_one_row
from ratingloom.operators.metrics import PREDICTED, selected_metric, stack


@dataclass
class Check:
    """One named check on a row of facts."""

    name: str
    passed: Column
    actual: Column
    expected: Column | str | int
    details: str = ""


def check_rows(facts: DataFrame, checks: list[Check]) -> DataFrame:
    """One ledger row per check, all read from one row of facts."""
    entries = [
        F.struct(
            F.lit(check.name).alias("check_name"),
            F.when(F.coalesce(check.passed, F.lit(False)), F.lit("PASS")).otherwise(F.lit("FAIL")).alias("status"),
            check.actual.cast("string").alias("actual"),
            (check.expected if isinstance(check.expected, Column) else F.lit(check.expected))
            .cast("string")
            .alias("expected"),
            F.lit(check.details).alias("details"),
        )
        for check in checks
    ]
    return facts.select(F.inline(F.array(*entries)))


def _equals(name: str, actual: Column, expected: Column | int | str) -> Check:
    wanted = expected if isinstance(expected, Column) else F.lit(expected)
    return Check(name, actual == wanted, actual, wanted)


def _shown(name: str) -> Column:
    """A measure at six digits, never in exponent form."""
    return F.round(name, 6).cast("decimal(28,6)")


def table_checks(
    raw: DataFrame,
    clean: DataFrame,
    predictions: DataFrame,
    required: list[str],
    first_year: int,
    last_year: int,
    expected: dict[str, int] | None = None,
) -> DataFrame:
    """Row counts, keys, required values, period range and prediction coverage.

    ``expected`` may fix ``raw_rows``, ``clean_rows`` and ``test_rows``; otherwise they must agree with
    each other only.
    """
    wanted = expected or {}
    missing = sum([F.col(n).isNull().cast("int") for n in required], F.lit(0))
    facts = raw.agg(F.count(F.lit(1)).alias("raw_rows"))
    facts = with_one_row(
        facts,
        clean.agg(
            F.count(F.lit(1)).alias("clean_rows"),
            F.count_distinct("vehicle_id").alias("clean_ids"),
            F.coalesce(F.sum(missing), F.lit(0)).cast("long").alias("missing_values"),
            F.min("model_year").alias("first_year"),
            F.max("model_year").alias("last_year"),
        ),
    )
    facts = with_one_row(
        facts,
        predictions.agg(
            F.count(F.lit(1)).alias("prediction_rows"),
            F.count_distinct("vehicle_id").alias("prediction_ids"),
            F.count_if(F.col("data_split") == "test").alias("test_rows"),
            F.count_if(is_finite(PREDICTED)).alias("finite_rows"),
        ),
    )
    c = F.col
    span = F.concat_ws("-", c("first_year").cast("string"), c("last_year").cast("string"))
    return check_rows(
        facts,
        [
            _equals("raw rows", c("raw_rows"), wanted.get("raw_rows", c("raw_rows"))),
            _equals("clean rows", c("clean_rows"), wanted.get("clean_rows", c("clean_rows"))),
            Check(
                "exact duplicates removed",
                c("raw_rows") >= c("clean_rows"),
                c("raw_rows") - c("clean_rows"),
                wanted["raw_rows"] - wanted["clean_rows"] if len(wanted) > 1 else ">= 0",
            ),
            _equals("unique vehicle ids", c("clean_ids"), c("clean_rows")),
            _equals("required clean values", c("missing_values"), 0),
            _equals("model years", span, f"{first_year}-{last_year}"),
            _equals("prediction rows", c("prediction_rows"), c("clean_rows")),
            _equals("prediction ids", c("prediction_ids"), c("clean_rows")),
            _equals("test rows", c("test_rows"), wanted.get("test_rows", c("test_rows"))),
            _equals("finite predictions", c("finite_rows"), c("prediction_rows")),
        ],
    )


def metric_checks(metrics: DataFrame, kpis: DataFrame, worst_mae: float) -> DataFrame:
    """One selected test metric, its error and R² within bounds, and agreement with the KPI row."""
    eligible = metrics.where(
        (F.col("model_scope") == "early_specification")
        & (F.col("split") == "test")
        & (F.col("eligible_for_selection") == 1)
    )
    facts = eligible.agg(F.count(F.lit(1)).alias("selected_rows"))
    facts = with_one_row(facts, kpis.agg(F.count(F.lit(1)).alias("kpi_rows"), F.max("test_mae_g_km").alias("kpi_mae")))
    facts = with_one_row(facts, selected_metric(metrics).agg(F.max("mae").alias("mae"), F.max("r_squared").alias("r2")))
    c = F.col
    return check_rows(
        facts,
        [
            _equals("single KPI row", c("kpi_rows"), 1),
            _equals("one selected test metric", c("selected_rows"), 1),
            Check("test MAE beats the baseline bound", c("mae") < worst_mae, _shown("mae"), f"< {worst_mae:g}"),
            Check("test R-squared bounded", c("r2").between(-1, 1), _shown("r2"), "between -1 and 1"),
            Check(
                "KPI MAE matches metrics",
                F.abs(c("kpi_mae") - c("mae")) < 1e-8,
                _shown("kpi_mae"),
                _shown("mae"),
            ),
        ],
    )


def reproduction_checks(found: DataFrame, tolerance: float) -> DataFrame:
    """A reloaded model must reproduce the stored predictions."""
    return check_rows(
        found,
        [
            Check(
                "saved model reproduces predictions",
                F.col("max_difference") <= tolerance,
                F.col("max_difference"),
                f"<= {tolerance}",
            )
        ],
    )


def view_checks(counts: DataFrame, expected: dict[str, int | None]) -> DataFrame:
    """Exact rows where a number is given, at least one row otherwise."""
    wanted = counts.sparkSession.createDataFrame(list(expected.items()), "view_name string, wanted long")
    joined = wanted.join(counts, "view_name", "left")
    rows = F.coalesce(F.col("view_rows"), F.lit(0))
    passed = F.when(F.col("wanted").isNull(), rows > 0).otherwise(rows == F.col("wanted"))
    return joined.select(
        F.concat(F.lit("view rows: "), "view_name").alias("check_name"),
        F.when(passed, F.lit("PASS")).otherwise(F.lit("FAIL")).alias("status"),
        rows.cast("string").alias("actual"),
        F.coalesce(F.col("wanted").cast("string"), F.lit("> 0")).alias("expected"),
        F.lit("").alias("details"),
    )


def validation_report(*ledgers: DataFrame) -> DataFrame:
    return stack(*ledgers)


def validation_summary(report: DataFrame) -> DataFrame:
    """Overall status, counts and names of failed checks; a ledger holds tens of rows."""
    failed = F.col("status") == "FAIL"
    return report.agg(
        F.when(F.count_if(failed) == 0, F.lit("PASS")).otherwise(F.lit("FAIL")).alias("status"),
        F.count(F.lit(1)).alias("checks_run"),
        F.count_if(~failed).alias("checks_passed"),
        F.count_if(failed).alias("checks_failed"),
        F.sort_array(F.collect_list(F.when(failed, F.col("check_name")))).alias("failed_checks"),
    )


def enforce_report(report: DataFrame) -> None:
    summary = validation_summary(report).first()
    if summary.status != "PASS":
        raise AssertionError(f"validation failed: {summary.failed_checks}")
