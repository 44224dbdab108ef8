"""Metrics, thresholds, selection and fitted models."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratingloom.operators import metrics as M, models as ML
from ratingloom.sources import schema as S


def scored(spark, rows):
    return spark.createDataFrame(rows, "k string, actual_co2_g_km double, predicted_co2_g_km double")


def test_metrics_agree_with_arrays(spark):
    rng = np.random.default_rng(3)
    y = rng.uniform(100, 400, 60)
    guess = y + rng.normal(0, 20, 60)
    df = scored(spark, [("all", float(a), float(b)) for a, b in zip(y, guess)])
    found = M.regression_metrics(df, keys=["k"]).first()
    error = guess - y
    wanted = {
        "mae": np.abs(error).mean(),
        "rmse": math.sqrt((error**2).mean()),
        "mape": (np.abs(error) / y).mean(),
        "r_squared": 1 - (error**2).sum() / ((y - y.mean()) ** 2).sum(),
        "mean_error_pred_minus_actual": error.mean(),
        "p90_absolute_error": np.quantile(np.abs(error), 0.9),
    }
    for name, value in wanted.items():
        assert found[name] == pytest.approx(value), name
    alone = M.regression_metrics(df).first()
    assert alone.mae == pytest.approx(wanted["mae"]) and alone.vehicle_records == 60


def test_metrics_of_degenerate_groups(spark):
    df = scored(spark, [("flat", 5.0, 4.0), ("flat", 5.0, 7.0), ("one", 3.0, 3.5), ("zero", 0.0, 1.0), ("zero", 2.0, 2.0), (None, 1.0, 1.0)])
    found = {r.k: r for r in M.regression_metrics(df, keys=["k"]).collect()}
    assert found["flat"].r_squared is None and found["one"].r_squared is None
    assert found["flat"].p90_absolute_error == pytest.approx(1.9)
    assert found["zero"].mape == pytest.approx(0.5 / 2.220446049250313e-16)
    assert found[None].mae == 0.0


def test_error_threshold_comes_from_one_split_and_flags_all(spark):
    rows = [("test", float(e)) for e in range(1, 12)] + [("train", 10.0), ("train", 9.9), ("train", None)]
    df = spark.createDataFrame(rows, "data_split string, absolute_error_g_km double")
    flagged = M.high_error_flag(df).where("high_error_flag = 1").collect()
    assert sorted((r.data_split, r.absolute_error_g_km) for r in flagged) == [("test", 10.0), ("test", 11.0), ("train", 10.0)]


def test_largest_errors_include_ties(spark):
    df = spark.createDataFrame([(i, float(min(i, 9))) for i in range(1, 12)], "id int, absolute_error_g_km double")
    found = M.worst_share(df)
    assert sorted((r.id, r.error_percentile) for r in found.collect()) == [(9, 1.0), (10, 1.0), (11, 1.0)]
    shared = M.worst_share(df, cut=0.70).where("id = 8").first()
    assert shared.error_percentile == pytest.approx(8 / 11)


def test_segments_stack(spark):
    rows = [(2022, "SUV", "X", 100.0, 110.0), (2022, "VAN", "X", 200.0, 190.0), (2023, "VAN", None, 300.0, 330.0)]
    df = spark.createDataFrame(rows, "model_year int, vehicle_class string, fuel_type string, actual_co2_g_km double, predicted_co2_g_km double")
    kinds = {"Model Year": "model_year", "Vehicle Class": "vehicle_class", "Fuel Type": "fuel_type"}
    found = {(r.segment_type, r.segment_value): r for r in M.segment_errors(df, kinds).collect()}
    assert set(found) == {("Model Year", "2022"), ("Model Year", "2023"), ("Vehicle Class", "SUV"), ("Vehicle Class", "VAN"), ("Fuel Type", "X")}
    assert (found["Vehicle Class", "VAN"].mae, found["Vehicle Class", "VAN"].average_predicted_co2_g_km) == (20.0, 260.0)


def test_split_summary_overlaps(spark):
    df = spark.createDataFrame([(2018, 1), (2020, 2), (2021, 3), (2022, 10)], "model_year int, y int")
    found = {r.split: r for r in M.split_summary(df, "y").collect()}
    assert {k: r.vehicle_records for k, r in found.items()} == {"train": 1, "validation": 2, "development": 3, "test": 1}
    assert (found["development"].first_model_year, found["development"].latest_model_year, found["development"].average_target) == (2018, 2021, 2.0)


# fixed values: validation errors of four tuned forests and of four candidate models
TUNED = [(1, 14.503152, 20.236132), (2, 13.185575, 19.323484), (3, 12.166137, 18.928142), (4, 12.234634, 19.047266)]
CANDIDATES = [("Median Baseline", 50.773779, 64.101803), ("Ridge Regression", 21.756464, 28.850725), ("Random Forest (Tuned)", 12.166137, 18.928142)]


def test_selection(spark):
    tuning = spark.createDataFrame(TUNED, "tuning_id int, mae double, rmse double")
    assert [r.tuning_id for r in ML.mark_selected(tuning).where("selected_configuration = 1").collect()] == [3]
    metrics = spark.createDataFrame([(i, *c) for i, c in enumerate(CANDIDATES)], "metric_id int, model_name string, mae double, rmse double")
    assert M.select_best(metrics).first().model_name == "Random Forest (Tuned)"
    tied = spark.createDataFrame([(2, 1.0, 2.0), (1, 1.0, 2.0), (3, 1.0, 2.5)], "metric_id int, mae double, rmse double")
    assert M.select_best(tied).first().metric_id == 1


def test_importance_ranks(spark):
    df = spark.createDataFrame([("m", "a", 3.0), ("m", "b", 9.0), ("m", "c", 3.0), ("m", "d", 1.0)], "model_name string, feature string, importance_mean_mae_increase double")
    assert {r.feature: r.importance_rank for r in M.importance_rank(df).collect()} == {"b": 1, "a": 2, "c": 2, "d": 4}


def test_importance_ranks_do_not_need_the_same_digits_twice(spark):
    # a mean that differs from evaluation to evaluation, as sums of doubles in another order do
    changing = F.udf(lambda v: v + random.random() / 1e9, "double").asNondeterministic()
    unsettled = spark.range(6).select(
        F.lit("m").alias("model_name"), changing(F.col("id").cast("double")).alias("importance_mean_mae_increase")
    )
    assert sorted(r.importance_rank for r in M.importance_rank(unsettled).collect()) == [1, 2, 3, 4, 5, 6]


def test_leaking_features_are_refused():
    assert ML.assert_no_leakage(ML.NUMERIC_FEATURES + ML.CATEGORICAL_FEATURES)
    with pytest.raises(ValueError, match="co2_rating"):
        ML.assert_no_leakage(["make", "co2_rating"])
    assert not set(S.LEAKY_COLUMNS) & set(ML.NUMERIC_FEATURES + ML.CATEGORICAL_FEATURES)


NUMERIC, CATEGORICAL = ["size"], ["make"]


@pytest.fixture(scope="module")
def cars(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(240):
        year = 2015 + i % 8
        size, make = float(rng.uniform(1, 6)), ["A", "B", "C'D"][i % 3]
        rows.append((i, year, size, make, 40 * size + {"A": 0, "B": 30, "C'D": 60}[make] + 100 + float(rng.normal(0, 1))))
    return spark.createDataFrame(rows, "vehicle_id int, model_year int, size double, make string, co2_emissions_g_km double").cache()


def test_preprocessor_uses_training_values_only(spark):
    train = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (6.0, "a"), (None, "b")], "size double, make string")
    other = spark.createDataFrame([(None, None), (2.0, "new")], "size double, make string")
    found = ML.preprocess(train, other, NUMERIC, CATEGORICAL).collect()
    filled = np.array([1, 2, 6, 2.0])
    assert found[0].features.toArray()[0] == pytest.approx((2 - filled.mean()) / filled.std())
    # the tie between a and b fills with a; a level unseen in training is all zeros
    assert found[0].make__filled == "a"
    assert list(found[0].make__levels.toArray()).count(1.0) == 1
    assert list(found[1].make__levels.toArray()) == [0.0, 0.0]


def test_ridge_matches_the_closed_form(spark, cars):
    model = ML.fit(cars, ML.ridge(cars), NUMERIC, CATEGORICAL)
    rows = model.transform(cars).select("features", "co2_emissions_g_km", "prediction").collect()
    x = np.array([r.features.toArray() for r in rows])
    y = np.array([r.co2_emissions_g_km for r in rows])
    centred, target = x - x.mean(0), y - y.mean()
    weights = np.linalg.solve(centred.T @ centred + ML.RIDGE_ALPHA * np.eye(x.shape[1]), centred.T @ target)
    assert np.allclose([r.prediction for r in rows], centred @ weights + y.mean(), atol=1e-3)


def test_parts_of_the_vector_store_do_not_grow_with_the_rows(cars, monkeypatch):
    monkeypatch.setattr(ML, "PART_ROWS", 10)
    known = ML.vectors(cars, NUMERIC, CATEGORICAL)
    assert known.rows.count() == 240 and len(known.rows.inputFiles()) >= 24


def test_evaluation_selects_on_validation_and_tests_once(spark, cars):
    frame = cars.withColumns({"leak": F.col("co2_emissions_g_km") / 10})
    found = ML.evaluate(
        ML.Splits(frame, "model_year", 2019, 2020),
        NUMERIC,
        CATEGORICAL,
        ["leak"],
        grid=[{"max_depth": 2, "min_samples_leaf": 1, "max_features": 1.0}, {"max_depth": 5, "min_samples_leaf": 1, "max_features": 1.0}],
        trees=5,
        boosting={"rounds": 3, "step": 0.3, "depth": 3, "leaf_rows": 1},
    )
    ledger = {(r.model_name, r.split): r for r in found.metrics.collect()}
    assert [r.metric_id for r in found.metrics.orderBy("metric_id").collect()] == list(range(1, 8))
    assert found.selected_name == "Ridge Regression" and ("Ridge Regression", "test") in ledger
    assert ledger["Ridge Regression", "test"].eligible_for_selection == 1
    assert ledger["Ridge Regression", "test"].mae < ledger["Median Baseline", "test"].mae / 3
    assert ledger["Median Baseline", "test"].eligible_for_selection == 0
    diagnostic = ledger["Measurement-Rich Forest (Diagnostic)", "test"]
    assert diagnostic.eligible_for_selection == 0 and diagnostic.model_scope != "early_specification"
    assert found.tuning.where("selected_configuration = 1").first().max_depth == 5
    assert found.parameters["max_depth"] == 5


def test_partners_are_a_permutation_per_repeat(cars):
    found = ML.shuffled_partners(cars, "vehicle_id", ["vehicle_id", "make"], 2).collect()
    assert len(found) == 480
    orders = {}
    for r in found:
        orders.setdefault(r["__repeat"], {})[r.vehicle_id] = r["__partner"].vehicle_id
    assert all(sorted(o) == sorted(o.values()) == list(range(240)) for o in orders.values())
    assert orders[1] != orders[2] and any(k != v for k, v in orders[1].items())


def test_a_short_first_walk_leaves_the_permutation_as_it_is(spark, monkeypatch):
    places = spark.range(1_025)  # nearly half of the places of a network fall outside

    def drawn(steps):
        monkeypatch.setattr(ML, "FIRST_STEPS", steps)
        return [r[0] for r in places.select(ML.permuted(F.col("id"), 1_025, F.lit(42), F.lit(1))).collect()]

    assert sorted(drawn(8)) == list(range(1_025)) and drawn(8) == drawn(1) == drawn(64)


def test_importance_and_reproduction(spark, cars, tmp_path):
    frame = cars.withColumn("noise", F.lit(1.0))
    model = ML.fit(frame, ML.ridge(frame), [*NUMERIC, "noise"], CATEGORICAL)
    table = ML.permutation_importance(model, frame, ["size", "noise", "make"], "vehicle_id", "Ridge", repeats=3)
    found = {r.feature: r for r in table.collect()}
    assert [found[n].importance_id for n in ("size", "make", "noise")] == [1, 2, 3]
    assert found["noise"].importance_mean_mae_increase == pytest.approx(0, abs=1e-9)
    assert found["size"].importance_mean_mae_increase > 20 and found["size"].importance_std > 0
    path = str(tmp_path / "model")
    model.write().save(path)
    stored = ML.predict(model, frame).select("vehicle_id", F.round("prediction", 3).alias("p"))
    check = ML.reproduction_check(path, frame, stored, "vehicle_id", "p").first()
    assert (check.rows_compared, check.reproduced) == (25, 1)
    wrong = stored.withColumn("p", F.col("p") + 1)
    assert ML.reproduction_check(path, frame, wrong, "vehicle_id", "p").first().reproduced == 0


def test_scored_rows(spark):
    df = spark.createDataFrame(
        [(1, "test", 200, 199.9994), (2, "test", 400, 410.0016), (3, "train", 100, 350.0)],
        "vehicle_id int, model_split string, co2_emissions_g_km int, prediction double",
    )
    found = {r.vehicle_id: r for r in M.score_rows(df, "m", "prediction", "co2_emissions_g_km").collect()}
    assert (float(found[1].predicted_co2_g_km), found[1].predicted_emission_band, float(found[1].prediction_error_g_km)) == (199.999, "<200", -0.001)
    assert (found[2].absolute_percentage_error, found[2].high_error_flag, found[3].high_error_flag) == (0.025005, 1, 1)
    assert (found[3].predicted_emission_band, found[3].absolute_percentage_error) == ("350+", 2.5)
    assert M.prediction_range(M.score_rows(df, "m", "prediction", "co2_emissions_g_km")).first().axis_high == 410.002


def test_a_forest_is_shuffled_as_levels_that_are_made_once(spark, cars, monkeypatch):
    frame = cars.withColumn("noise", F.lit(1.0))
    odd = frame.limit(3).withColumn("co2_emissions_g_km", F.lit(None).cast("double")).withColumn("size", F.lit(None).cast("double"))
    model = ML.fit(frame, ML.forest(max_depth=4, trees=3), [*NUMERIC, "noise"], CATEGORICAL)
    runs, run = [], ML.PipelineModel._transform
    monkeypatch.setattr(ML.PipelineModel, "_transform", lambda self, df: runs.append(1) or run(self, df))

    def found(df):
        rows = ML.permutation_importance(model, df, ["size", "noise", "make"], "vehicle_id", "Forest", repeats=3).collect()
        return [(r.importance_id, r.feature, r.importance_mean_mae_increase, r.importance_std) for r in rows]

    known = frame.unionByName(odd.withColumn("vehicle_id", F.col("vehicle_id") + 1_000))
    by_levels, alone = found(known), found(odd)
    assert len(runs) == 2
    monkeypatch.setattr(ML, "level_slots", lambda model, features: None)
    for new, old in zip(by_levels + alone, found(known) + found(odd), strict=True):
        assert new[:2] == old[:2] and new[2:] == pytest.approx(old[2:], abs=1e-9)
