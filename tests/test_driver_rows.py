"""Registered queries over small driver tables that each test builds."""

import datetime

import pytest

import __spark_entry__ as entry
from ratingloom.operators import models as ML
from registry import evaluation

LINE = (
    "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
    "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
)
PART = "p_partkey long, p_name string, p_brand string, p_type string, p_size int"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Ratings of the seven years, a twentieth of them twice."""
    top = tmp_path_factory.mktemp("driver")
    kinds = ["ECONOMY", "SMALL", "MEDIUM", "LARGE", "PROMO", "STANDARD"]
    parts = [(i, f"part {i % 7}", f"Brand#{i % 4}", kinds[i % 6], 1 + i * 7 % 50) for i in range(40)]
    lines = []
    for i in range(400):
        shipped = datetime.datetime(1995 + i % 7, 1 + i % 12, 1 + i % 28)
        line = (i // 3, i * 11 % 40, i % 13, 1 + i % 7, 1.0 + i * 13 % 50, 20_000.0 + i * 7919 % 60_000)
        lines += [(*line, 0.01 * (i % 9), 0.01 * (i % 7), "ANR"[i % 3], "FO"[i % 2], shipped)] * (2 if i % 20 == 0 else 1)
    spark.createDataFrame(parts, PART).write.parquet(f"{top}/part.parquet")
    spark.createDataFrame(lines, LINE).write.parquet(f"{top}/lineitem.parquet")
    return str(top)


def test_the_tuning_grows_all_trees_of_the_library(spark, folder):
    found = entry.queries()["rf_tuning"](spark, folder).orderBy("tuning_id").collect()
    assert [r.n_estimators for r in found] == [ML.FOREST_TREES] * 4 and ML.FOREST_TREES == 300
    assert [r.max_depth for r in found] == [point["max_depth"] for point in ML.FOREST_GRID]


def test_the_wide_join_of_the_details_runs_in_slices(spark, folder, monkeypatch):
    whole = sorted(map(str, entry.queries()["vehicle_detail"](spark, folder).collect()))
    kept, store = [], evaluation.stored
    monkeypatch.setattr(evaluation, "SLICE_ROWS", 100)
    monkeypatch.setattr(evaluation, "stored", lambda df, name: kept.append(name) or store(df, name))
    assert sorted(map(str, entry.queries()["vehicle_detail"](spark, folder).collect())) == whole and len(whole) == 420
    assert kept.count("detail") == 5
