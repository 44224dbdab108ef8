"""Positions, ranks, tiles and quantiles over skewed groups."""

import random

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from ratingloom.operators import ordering as O, quantiles as Q


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows; values repeat; one key is null."""
    rng = random.Random(7)
    data = [(i, "hot" if i % 10 < 7 else rng.choice(["a", "b", None]), rng.randrange(12)) for i in range(400)]
    return spark.createDataFrame(data, "id long, k string, v int").repartition(7).cache()


def pairs(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=str)


def test_row_position(skewed):
    found = O.row_position(skewed, ["-v", "id"], ["k"])
    window = Window.partitionBy("k").orderBy(F.desc("v"), "id")
    wanted = skewed.withColumn("position", F.row_number().over(window))
    assert pairs(found, "id", "position") == pairs(wanted, "id", "position")
    assert set(found.columns) == {*skewed.columns, "position"}


def test_global_position_with_start(skewed):
    found = O.row_position(skewed, ["id"], start=2)
    assert pairs(found, "id", "position") == sorted([(i, i + 2) for i in range(400)], key=str)


def test_rank_leaves_gaps(skewed):
    found = O.with_rank(skewed, ["-v"], ["k"])
    wanted = skewed.withColumn("rank", F.rank().over(Window.partitionBy("k").orderBy(F.desc("v"))))
    assert pairs(found, "id", "rank") == pairs(wanted, "id", "rank")


def test_global_rank(skewed):
    found = O.with_rank(skewed, ["v"])
    wanted = skewed.withColumn("rank", F.rank().over(Window.orderBy("v")))
    assert pairs(found, "id", "rank") == pairs(wanted, "id", "rank")


@pytest.mark.parametrize("tiles", [4, 7])
def test_tiles(skewed, tiles):
    found = O.with_tile(skewed, ["-v", "id"], tiles, ["k"])
    window = Window.partitionBy("k").orderBy(F.desc("v"), "id")
    assert pairs(found, "id", "tile") == pairs(skewed.withColumn("tile", F.ntile(tiles).over(window)), "id", "tile")


def test_tiles_of_a_group_smaller_than_their_number(spark):
    df = spark.range(5)
    found = O.with_tile(df, ["id"], 4)
    assert [r.tile for r in found.orderBy("id").collect()] == [1, 1, 2, 3, 4]
    few = O.with_tile(df.where("id < 2"), ["id"], 4)
    assert [r.tile for r in few.orderBy("id").collect()] == [1, 2]


def test_cume_dist_includes_ties(spark):
    df = spark.createDataFrame([(v,) for v in [1, 1, 2, 3, 3, 3, 4, 4, 4, 4]], "v int")
    shares = O.with_cume_dist(Q.value_counts(df, "v"), "v", Q.ROWS)
    assert {r.v: r.cume_dist for r in shares.collect()} == {1: 0.2, 2: 0.3, 3: 0.6, 4: 1.0}


def test_running_totals(spark):
    df = spark.createDataFrame([("a", i, i) for i in range(1, 40)] + [("b", 1, 5)], "k string, o int, w int")
    found = O.running_totals(df, ["o"], "w", ["k"]).where("k = 'a'").orderBy("o")
    assert [r.running for r in found.collect()] == list(np.cumsum(range(1, 40)))


def test_quantiles_interpolate(skewed):
    probs = {"p10": 0.1, "p25": 0.25, "median": 0.5, "p90": 0.9, "top": 1.0}
    found = {r.k: r for r in Q.grouped_quantiles(skewed, "v", probs, ["k"]).collect()}
    data = {}
    for row in skewed.collect():
        data.setdefault(row.k, []).append(row.v)
    assert set(found) == set(data)
    for key, items in data.items():
        for name, p in probs.items():
            assert found[key][name] == pytest.approx(np.quantile(items, p)), (key, name)


def test_quantiles_of_small_groups(spark):
    df = spark.createDataFrame(
        [("one", 5.0), ("even", 1.0), ("even", 2.0), ("same", 3.0), ("same", 3.0), ("nan", float("nan")), ("nan", 8.0), ("null", None)],
        "k string, v double",
    )
    found = {r.k: (r.m, r.q) for r in Q.grouped_quantiles(df, "v", {"m": 0.5, "q": 0.25}, ["k"]).collect()}
    assert found == {"one": (5.0, 5.0), "even": (1.5, 1.25), "same": (3.0, 3.0), "nan": (8.0, 8.0)}


def test_global_quantile(skewed):
    found = Q.grouped_quantiles(skewed, "v", {"p": 0.9}).first()
    assert found.p == pytest.approx(np.quantile([r.v for r in skewed.collect()], 0.9))


@pytest.mark.parametrize("at_once, cuts", [(1, 2), (3, 4), (20, 1_024)])
def test_quantiles_are_narrowed_down_in_passes(spark, monkeypatch, at_once, cuts):
    monkeypatch.setattr(Q, "AT_ONCE", at_once)
    monkeypatch.setattr(Q, "CUTS", cuts)
    rng = random.Random(3)
    groups = {
        "even": [rng.gauss(0, 1) for _ in range(300)],
        "far": [1e308, -1e308, 0.0, 0.0, *[1 + i * 1e-9 for i in range(60)]],
        "tied": [2.0] * 500 + [float(i) for i in range(30)],
        "endless": [float("-inf"), float("-inf"), 1.0, 2.0, 3.0, 4.0, 5.0, float("inf")],
        None: [5.0, 7.0],
    }
    probs = {"p0": 0.0, "p25": 0.25, "median": 0.5, "p90": 0.9}
    df = spark.createDataFrame([(k, v) for k, items in groups.items() for v in items], "k string, v double")
    found = {r.k: r for r in Q.grouped_quantiles(df.repartition(5), "v", probs, ["k"]).collect()}
    assert set(found) == set(groups)
    for key, items in groups.items():
        for name, p in probs.items():
            at, ordered = (len(items) - 1) * p, sorted(items)
            low, high = ordered[int(np.floor(at))], ordered[int(np.ceil(at))]
            if np.isfinite(low) and np.isfinite(high):
                assert found[key][name] == pytest.approx(low + (high - low) * (at - np.floor(at)), rel=1e-12), (key, name)
    whole = [v for k, items in groups.items() if k != "endless" for v in items]
    number = df.where("k is null or k != 'endless'").select(F.round(F.col("v") / 1e300).cast("long").alias("v"))
    assert Q.grouped_quantiles(number, "v", {"m": 0.5}).first().m == np.quantile([round(v / 1e300) for v in whole], 0.5)


def test_orders_of_mixed_direction_with_nulls_and_nan(spark):
    rng = random.Random(5)
    data = [(i, rng.choice(["a", "b", None]), rng.choice([None, float("nan"), 1.0, 2.0, -3.5])) for i in range(600)]
    df = spark.createDataFrame(data, "id long, s string, x double").repartition(5)
    for order in (["s", "-x", "id"], ["-s", "x", "-id"], ["-x", "s", "id"]):
        wanted = df.withColumn("position", F.row_number().over(Window.orderBy(*O.order_columns(order))))
        assert pairs(O.row_position(df, order), "id", "position") == pairs(wanted, "id", "position")


def test_ties_and_empty_frames(spark):
    tied = spark.createDataFrame([("a", 1)] * 90 + [("b", 1)] * 10, "k string, v int").repartition(6)
    found = O.row_position(tied, ["v"], ["k"])
    assert pairs(found, "k", "position") == pairs(
        spark.createDataFrame([("a", i) for i in range(1, 91)] + [("b", i) for i in range(1, 11)], "k string, position long"), "k", "position"
    )
    none = tied.where("v > 1")
    assert O.row_position(none, ["v"]).count() == 0
    assert O.with_rank(none, ["v"], ["k"]).count() == 0
    assert Q.grouped_quantiles(none, "v", {"m": 0.5}, ["k"]).count() == 0
    assert Q.grouped_quantiles(none, "v", {"m": 0.5}).first().m is None


def test_dense_key_of_sparse_and_dense_ids(spark):
    for ids in (range(50), [i * 7_919_000_003 for i in range(50)]):
        df = spark.createDataFrame([(i,) for i in ids], "n long").repartition(5)
        keyed = O.dense_key(df, "n", "key")
        assert pairs(keyed, "n", "key") == sorted([(n, at) for at, n in enumerate(ids, start=1)], key=str)


@pytest.mark.parametrize("split", ["64", "100000"])
def test_natural_position_follows_path_and_line(spark, tmp_path, split):
    """A small first file and a large second one; Spark reads the large one first."""
    (tmp_path / "a_small.csv").write_text("n\n0\n1\n")
    (tmp_path / "b_big.csv").write_text("n\n" + "".join(f"{i}\n" for i in range(2, 200)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        numbered = O.natural_position(spark.read.schema("n long").csv(str(tmp_path), header=True), "line", start=2)
        assert pairs(numbered, "n", "line") == sorted([(i, i + 2) for i in range(200)], key=str)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_no_plan_sorts_detail_rows_in_one_task(skewed):
    for df in (
        O.row_position(skewed, ["id"]),
        O.with_rank(skewed, ["v"]),
        O.with_tile(skewed, ["id"], 4, ["k"]),
        Q.grouped_quantiles(skewed, "v", {"p": 0.9}, ["k"]),
        O.dense_key(skewed, "id", "key"),
    ):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        for window in [line for line in plan.splitlines() if "Window" in line]:
            assert "__part" in window, window


@pytest.mark.parametrize("parts", [1, 7])
def test_results_do_not_depend_on_partitions(skewed, parts):
    df = skewed.repartition(parts)
    assert pairs(O.sample_cap(df, 25, 3, ["id"]), "id") == pairs(O.sample_cap(skewed, 25, 3, ["id"]), "id")
    assert O.sample_cap(df, 25, 3, ["id"]).count() == 25
    assert O.sample_cap(df, 9_999, 3, ["id"]).count() == 400
    assert pairs(O.sample_cap(df, 25, 3, ["id"]), "id") != pairs(O.sample_cap(df, 25, 4, ["id"]), "id")


def test_top_n_and_display_order(spark):
    df = spark.createDataFrame([("a", 1), ("b", 3), ("c", 3), ("d", 2)], "k string, v int")
    assert [r.k for r in O.top_n(df, ["-v", "k"], 2).collect()] == ["b", "c"]
    assert [r.k for r in O.top_n_displayed(df, ["-v", "k"], 3, ["v", "k"]).collect()] == ["d", "b", "c"]
    assert [r.k for r in O.head_by(df, "k", 1).collect()] == ["a"]


def test_places_are_stored_packed_and_joined_without_a_shuffle(skewed):
    plan = O.row_position(skewed, ["id"])._jdf.queryExecution().analyzed().toString().lower()
    assert "parquet" in plan and "broadcast" in plan


def test_whole_numbers_are_ranked_where_they_are(spark, monkeypatch):
    numbers = [-70_000, -1, 0, 1, 7, 8, 9, 32_767, 32_768, 32_769, 65_535, 65_536, 1_000_000]
    df = spark.createDataFrame([(n, str(n)) for n in reversed(numbers)], "n long, name string").repartition(3)

    def keys(df):
        return sorted((r.vehicle_id, r.n, r.name) for r in O.dense_key(df, "n").collect())

    wanted = [(i, n, str(n)) for i, n in enumerate(numbers, start=1)]
    with monkeypatch.context() as m:
        m.setattr(O, "row_position", None)
        assert keys(df) == wanted and keys(df.withColumn("n", F.col("n").cast("int"))) == wanted
    # missing, repeated and far numbers move rows as before
    assert [k for k, *_ in keys(df.unionByName(df.limit(1)))] == list(range(1, 15))
    assert [r.vehicle_id for r in O.dense_key(df.unionByName(spark.createDataFrame([(None, "x")], df.schema)), "n").orderBy("vehicle_id").collect()] == list(range(1, 15))
    monkeypatch.setattr(O, "BITMAPS", 1)
    assert keys(df) == wanted
