"""The whole job on a small generated file, its views through SQL, and the registry contract."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from ratingloom.plans import job, pages as P, validation as V, views as W
from ratingloom.sources import schema as S

CLASSES = ["COMPACT", "SUV: STANDARD", "Mid-Size", "VAN - CARGO"]


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    rng = random.Random(5)
    lines = [",".join(S.COLUMN_MAP)]
    for i in range(360):
        year = 1995 + i % 29
        kind, cylinders = CLASSES[i % 4], rng.choice([4, 6, 8])
        engine = round(cylinders * 0.6 + rng.random(), 1)
        city = round(5 + cylinders + rng.random() * 2, 1)
        highway = round(city - 2 - rng.random(), 1)
        combined = round(0.55 * city + 0.45 * highway, 1)
        rating = str(rng.randint(1, 10)) if year >= 2016 else ""
        fields = [year, f"Make {i % 6}", f"model {i % 40}", kind, engine, cylinders, rng.choice(["A4", "AS8", "M6", "AV"]),
                  rng.choice("XZD"), city, highway, combined, round(282.5 / combined), round(combined * 23), rating, rating]
        lines.append(",".join(map(str, fields)))
    lines.append(lines[10])
    folder = tmp_path_factory.mktemp("job")
    source = folder / "ratings.csv"
    source.write_text("\n".join(lines) + "\n")
    small = job.Settings(
        trees=3,
        grid=[{"max_depth": 3, "min_samples_leaf": 1, "max_features": 1.0}],
        boosting={"rounds": 2, "step": 0.3, "depth": 3, "leaf_rows": 1},
        repeats=2,
    )
    report = job.run(spark, str(source), str(folder / "out"), small).cache()
    return folder / "out", report


def test_every_check_passes(run):
    _, report = run
    summary = V.validation_summary(report).first()
    assert (summary.status, summary.checks_failed, list(summary.failed_checks)) == ("PASS", 0, [])
    assert summary.checks_run == report.count() >= 24


def test_artifacts(spark, run):
    folder, _ = run
    assert spark.read.parquet(str(folder / "clean")).count() == 360
    removed = spark.read.option("header", True).csv(str(folder / "removed_exact_duplicates")).collect()
    assert [r.source_row_number for r in removed] == ["362"]
    manifest = spark.read.option("header", True).csv(str(folder / "results_manifest")).collect()
    assert len(manifest) == 9 and all(len(r.sha256) == 64 for r in manifest)
    audit = spark.read.json(str(folder / "data_audit_report")).first()
    assert (audit.source_rows, audit.validation_checks.clean_rows) == (361, 360)
    source = (folder.parent / "ratings.csv").read_bytes()
    assert [(f.file, f.bytes, f.sha256) for f in audit.source_files] == [("ratings.csv", len(source), hashlib.sha256(source).hexdigest())]
    assert audit.elapsed_seconds > 0 and "make" in audit.features_of_primary_model
    metadata = spark.read.json(str(folder / "model_metadata")).first()
    assert sorted(metadata.excluded_columns) == sorted(S.LEAKY_COLUMNS) and len(metadata.features) == 8
    assert {s.split: s.vehicle_records for s in metadata.splits}["development"] + {s.split: s.vehicle_records for s in metadata.splits}["test"] == 360
    assert metadata.prediction_range.minimum <= metadata.prediction_range.maximum and metadata.test_mae > 0
    trend = spark.read.option("header", True).csv(str(folder / "exports" / "yearly_trend")).collect()
    assert [r.model_year for r in trend] == [str(y) for y in range(1995, 2024)]


def test_views_answer_sql(spark, run):
    assert spark.sql("SELECT count(*) FROM vw_dashboard_vehicle_detail WHERE predicted_co2_g_km IS NULL").first()[0] == 0
    assert spark.table("vw_dashboard_vehicle_detail").columns == S.DETAIL_COLUMNS
    kpis = spark.table("vw_dashboard_kpis").first()
    best = spark.sql(
        "SELECT min(mae) FROM vw_dashboard_model_performance WHERE split = 'test' AND eligible_for_selection = 1"
    ).first()[0]
    assert (kpis.vehicle_records, kpis.years_covered, kpis.test_mae_g_km) == (360, 29, best)
    ranks = spark.sql("SELECT importance_rank FROM vw_dashboard_feature_importance ORDER BY 1").collect()
    assert [r[0] for r in ranks][0] == 1 and len(ranks) == 8
    totals = spark.sql(
        "SELECT segment_type, sum(vehicle_records) AS n FROM vw_dashboard_test_segment_errors GROUP BY segment_type"
    ).collect()
    assert len({r.n for r in totals}) == 1 and len(totals) == 4


def test_model_page(spark, run):
    table = spark.table
    predictions = table("vw_dashboard_vehicle_detail").where("model_split = 'test'").withColumn(
        "actual_co2_g_km", F.col("co2_emissions_g_km")
    )
    page = P.model_page(
        table("vw_dashboard_model_performance"),
        table("vw_dashboard_feature_importance"),
        table("vw_dashboard_test_segment_errors"),
        predictions,
        segment_type="Vehicle Class",
        cap=10,
    )
    assert page["selected"].count() == 1 and page["sample"].count() == 10
    assert page["axis"].first().lowest < page["axis"].first().highest
    assert page["validation"].count() == 4 and page["importance"].count() == 8
    assert {r.segment_label for r in page["segments"].collect()} == {"Vehicle Class"}


def test_view_assertions(spark):
    views = {"full": spark.range(3), "none": spark.range(0)}
    counts = W.view_counts(views)
    assert W.assert_counts(counts, {"full": 3}) == {"full": 3, "none": 0}
    with pytest.raises(AssertionError):
        W.assert_counts(counts, {"full": 4})
    with pytest.raises(AssertionError):
        W.assert_counts(counts, {}, ["none"])
    failed = V.view_checks(counts, {"full": 3, "none": None, "gone": 0}).where("status = 'FAIL'").collect()
    assert [r.check_name for r in failed] == ["view rows: none"]
    with pytest.raises(AssertionError, match="view rows: none"):
        V.enforce_report(V.view_checks(counts, {"none": None}))


def test_kpis_are_empty_without_an_eligible_metric(spark):
    metrics = spark.table("vw_dashboard_model_performance").withColumn("eligible_for_selection", F.lit(0))
    detail = spark.table("vw_dashboard_vehicle_detail")
    predictions = detail.withColumn("data_split", F.col("model_split"))
    assert W.kpis(detail, metrics, predictions).count() == 0
