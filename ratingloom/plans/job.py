"""The end-to-end job: ingest, clean, audit, load, evaluate, publish views and exports, validate.

Every stage is a function of DataFrames; stages meet at Parquet tables, as do separate jobs on a cluster.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from ratingloom.operators import metrics as M, models as ML
from ratingloom.operators.benchmarks import class_year_stats, group_summaries, make_year_summary, yearly_summary
from ratingloom.operators.cleaning import clean_ratings, cleaning_log, split_exact_duplicates
from ratingloom.operators.joins import settled
from ratingloom.operators.ordering import natural_position, summary_position
from ratingloom.operators.quality import audit_report, dq_checks, enforce, with_provenance
from ratingloom.operators.scenario import top_opportunities
from ratingloom.plans import validation as V, views as W
from ratingloom.sources import schema as S, writers as IO
from ratingloom.sources.literals import data_dictionary, fuel_type_lookup, transmission_family_lookup
from ratingloom.sources.readers import fingerprint, read_ratings


@dataclass
class Settings:
    """Periods and model sizes of a run."""

    first_year: int = S.FIRST_YEAR
    last_year: int = S.LAST_YEAR
    base_year: int = S.BASE_YEAR
    train_until: int = S.TRAIN_UNTIL
    validate_until: int = S.VALIDATE_UNTIL
    recent_since: int = S.RECENT_SINCE
    trees: int = ML.FOREST_TREES
    grid: list[dict] = field(default_factory=lambda: list(ML.FOREST_GRID))
    boosting: dict = field(default_factory=lambda: dict(ML.BOOSTING))
    repeats: int = ML.REPEATS
    worst_mae: float = 50.0


def ingest(spark: SparkSession, csv: str, folder: str) -> DataFrame:
    """Raw rows with their source row number, as a Parquet table."""
    numbered = natural_position(read_ratings(spark, csv))
    numbered.write.mode("overwrite").parquet(f"{folder}/raw")
    return spark.read.schema(numbered.schema).parquet(f"{folder}/raw")


def clean(spark: SparkSession, raw: DataFrame, folder: str, settings: Settings, csv: str | None = None) -> DataFrame:
    """Clean table, verified; the removed duplicates, the audit and the summaries are written beside it. The audit names
    the files of ``csv`` with their digests, and the seconds from the start of the stage."""
    started = time.time()
    _, removed = split_exact_duplicates(raw, list(S.COLUMN_MAP), "source_row_number")
    IO.export_csv(removed.orderBy("source_row_number"), f"{folder}/removed_exact_duplicates", single_file=False)
    cleaned = clean_ratings(raw, "source_row_number", settings.train_until, settings.validate_until)
    bad = (F.col("co2_emissions_g_km") <= 0) | (F.col("engine_size_l") <= 0) | (F.col("cylinders") <= 0)
    table = IO.load_table(cleaned, f"{folder}/clean", S.CLEAN_COLUMNS, "vehicle_id", bad)
    enforce(dq_checks(table, settings.first_year, settings.last_year))
    audit = audit_report(raw, table)
    if csv:
        features = ML.NUMERIC_FEATURES + ML.CATEGORICAL_FEATURES
        audit = with_provenance(audit, fingerprint(spark, csv), round(time.time() - started, 3), features)
    IO.write_report(audit, f"{folder}/data_audit_report")
    IO.export_csv(cleaning_log(raw, list(S.COLUMN_MAP), "source_row_number"), f"{folder}/cleaning_log")
    IO.export_csv(data_dictionary(table).orderBy("position"), f"{folder}/data_dictionary")
    plain = {
        "yearly_summary": yearly_summary(table, settings.base_year),
        "class_year_stats": class_year_stats(table),
        "make_year_summary": make_year_summary(table),
    }
    IO.export_all(group_summaries(table) | plain, f"{folder}/summaries")
    IO.export_csv(top_opportunities(table, settings.recent_since), f"{folder}/summaries/top_opportunities")
    return table


def train(spark: SparkSession, table: DataFrame, folder: str, settings: Settings) -> W.Tables:
    """Evaluate the candidates, score every row and store the model tables."""
    parts = ML.Splits(table, "model_year", settings.train_until, settings.validate_until)
    found = ML.evaluate(parts, grid=settings.grid, trees=settings.trees, boosting=settings.boosting)
    if found.model is None:
        scored = ML.median_baseline(parts.development, table)
    else:
        found.model.write().overwrite().save(f"{folder}/model")
        scored = ML.predict(found.model, table)
    rows = M.score_rows(scored, found.selected_name, ML.RAW_PREDICTION, ML.TARGET)

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    wide = kept(rows.select(*M.PREDICTION_COLUMNS, "model_year", "vehicle_class", "fuel_type", "engine_size_band"), "scored")
    errors = settled(M.segment_errors(wide.where(F.col("data_split") == "test")))
    features = ML.NUMERIC_FEATURES + ML.CATEGORICAL_FEATURES
    if found.model is None:
        importance = spark.createDataFrame(
            [],
            "importance_id long, model_name string, feature string, importance_mean_mae_increase double, "
            "importance_std double",
        )
    else:
        importance = ML.permutation_importance(
            found.model, parts.test, features, "vehicle_id", found.selected_name, settings.repeats
        )
    kept(found.tuning, "model_tuning_results")
    ledger = kept(found.metrics, "model_metrics")
    IO.write_report(
        M.model_metadata(
            ledger,
            M.split_summary(table, ML.TARGET, settings.train_until, settings.validate_until),
            wide,
            features,
            S.LEAKY_COLUMNS,
            ML.TARGET,
            found.parameters if found.selected_name.startswith("Random Forest") else None,
        ),
        f"{folder}/model_metadata",
    )
    return W.Tables(
        ratings=table,
        fuels=fuel_type_lookup(spark),
        transmissions=transmission_family_lookup(spark),
        predictions=wide.select(*M.PREDICTION_COLUMNS),
        metrics=ledger,
        importance=kept(importance, "feature_importance"),
        segment_errors=kept(
            summary_position(errors, ["segment_type", "segment_value"], "segment_error_id"), "model_segment_errors"
        ),
        base_year=settings.base_year,
        recent_since=settings.recent_since,
    )


def publish(spark: SparkSession, tables: W.Tables, folder: str) -> dict[str, DataFrame]:
    """Register the views, check them, export the result set and its manifest."""
    views = W.build_views(tables)
    W.register_views(views)
    rows = tables.ratings.count()
    W.assert_counts(W.view_counts(views), {"vehicle_detail": rows, "kpis": 1}, ["test_segment_errors"])
    if W.missing_predictions(views["vehicle_detail"]).first()[0]:
        raise AssertionError("rows without a prediction")
    tuning = spark.read.parquet(f"{folder}/model_tuning_results")
    frames = W.export_set(tables, tuning, views)
    written = IO.export_all(frames, f"{folder}/exports")
    IO.export_csv(IO.manifest(spark, f"{folder}/exports", frames, written), f"{folder}/results_manifest")
    return views


def validate(spark: SparkSession, raw: DataFrame, tables: W.Tables, views: dict, folder: str, settings: Settings) -> DataFrame:
    """The ledger over tables, metrics, views and the saved model; a failed check raises."""
    required = ["vehicle_id", "model_year", "make", "vehicle_class", "engine_size_l", "cylinders", "fuel_type", ML.TARGET]
    ledgers = [
        V.table_checks(raw, tables.ratings, tables.predictions, required, settings.first_year, settings.last_year),
        V.metric_checks(tables.metrics, views["kpis"], settings.worst_mae),
        V.view_checks(W.view_counts(views), {name: None if name != "kpis" else 1 for name in views}),
    ]
    selected = M.selected_metric(tables.metrics).first()["model_name"]
    if selected != "Median Baseline":
        found = ML.reproduction_check(
            f"{folder}/model", tables.ratings, tables.predictions, "vehicle_id", M.PREDICTED
        )
        ledgers.append(V.reproduction_checks(found, ML.REPRODUCTION_TOLERANCE))
    report = settled(V.validation_report(*ledgers))
    IO.export_csv(report, f"{folder}/validation_checks")
    IO.write_report(V.validation_summary(report), f"{folder}/validation_report")
    V.enforce_report(report)
    return report


def run(spark: SparkSession, csv: str, folder: str, settings: Settings | None = None) -> DataFrame:
    """All stages in order; returns the validation ledger."""
    settings = settings or Settings()
    raw = ingest(spark, csv, folder)
    table = clean(spark, raw, folder, settings, csv)
    tables = train(spark, table, folder, settings)
    views = publish(spark, tables, folder)
    return validate(spark, raw, tables, views, folder, settings)
