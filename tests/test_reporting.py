"""Trends, benchmarks, cubes, scenarios and pages on small literal frames."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ratingloom.operators import benchmarks as B, cube as K, joins as J, scenario as X
from ratingloom.plans import pages as P
from ratingloom.sources import schema as S

# fixed values: published yearly averages at four digits, yearly change and change since 1995
PUBLISHED = [
    (1995, "307.6639", None, "0"),
    (1996, "296.1862", "-0.03730597", "-0.03730597"),
    (1997, "295.8617", "-0.00109559", "-0.03836069"),
    (1998, "297.9905", "0.00719525", "-0.03144145"),
]

FACT = "vehicle_id int, model_year int, make string, model string, vehicle_class string, fuel_type string, engine_size_l decimal(4,1), fuel_cons_comb_l_100km decimal(5,1), co2_emissions_g_km int"


@pytest.fixture(scope="module")
def fact(spark):
    rows = [
        (1, 1995, "A", "one", "SUV", "X", 2.0, 8.0, 200),
        (2, 1995, "A", "two", "SUV", "X", 3.0, 9.0, 201),
        (3, 1995, "B", "three", "SUV", "Z", 4.1, 10.0, 300),
        (4, 1997, "A", "one", "SUV", "X", 2.0, 7.5, 190),
        (5, 1997, "B", "four", "VAN", "D", 3.0, 9.5, 250),
        (6, 2022, "A", "one", "VAN", "X", 1.8, 7.0, 180),
        (7, 2022, "B", "five", "VAN", "Z", 3.6, 9.0, 220),
        (8, 2022, "B", "six", "VAN", "Z", 3.6, 9.0, 220),
        (9, 2022, "C", "seven", "VAN", None, 5.0, 12.0, 300),
    ]
    as_text = [(*r[:6], Decimal(str(r[6])), Decimal(str(r[7])), r[8]) for r in rows]
    return B.peer_benchmark(spark.createDataFrame(as_text, FACT), ["model_year", "vehicle_class"], "co2_emissions_g_km").cache()


def test_published_changes_follow_from_rounded_averages(spark):
    df = spark.createDataFrame([(y, Decimal(a)) for y, a, _, _ in PUBLISHED], "model_year int, avg decimal(14,4)")
    moved = B.with_change(B.with_lag(df, "avg", "model_year", "last"), "avg", "last", "yoy")
    found = B.with_base_change(moved, "avg", "model_year", 1995, "base").orderBy("model_year").collect()
    for row, (_, _, yoy, base) in zip(found, PUBLISHED):
        assert row.yoy == (None if yoy is None else Decimal(yoy))
        assert row.base == Decimal(base)


def test_missing_base_year(fact):
    assert B.yearly_trend(fact, base=1996).count() == 0
    with pytest.raises(Exception, match="no row for base period 1996"):
        B.yearly_summary(fact, base=1996).collect()


def test_trend_rows(fact):
    found = {r.model_year: r for r in B.yearly_trend(fact).collect()}
    assert found[1995].average_co2_g_km == Decimal("233.6667")
    assert found[1995].previous_year_average_co2 is None
    assert found[1997].previous_year_average_co2 == Decimal("233.6667")
    assert found[1997].co2_yoy_change_pct == Decimal("-0.05848801")
    rolled = {r.model_year: float(r.rolling_three_year_average_co2) for r in B.rolling_trend(fact).collect()}
    assert rolled[2022] == pytest.approx((233.6667 + 220 + 230) / 3, abs=1e-4)
    plain = {r.model_year: r for r in B.yearly_summary(fact).collect()}
    assert (plain[1995].median_co2_g_km, plain[2022].average_co2_g_km) == (201.0, 230.0)


def test_peers(fact):
    rows = {r.vehicle_id: r for r in fact.collect()}
    assert (float(rows[1].class_year_co2_median), float(rows[1].class_year_co2_p25)) == (201.0, 200.5)
    assert [float(rows[i].co2_gap_to_class_p25) for i in (1, 2, 3)] == [0.0, 0.5, 99.5]
    assert [rows[i].above_class_year_median for i in (1, 2, 3)] == [0, 0, 1]
    assert (float(rows[4].class_year_co2_median), float(rows[4].co2_gap_to_class_p25)) == (190.0, 0.0)
    assert float(rows[1].co2_vs_class_year_median) == -1.0


def test_rows_without_a_peer_group(spark):
    df = spark.createDataFrame([(None, 5), ("a", 7)], "k string, v int")
    found = {r.k: r for r in B.peer_benchmark(df, ["k"], "v").collect()}
    assert found[None].class_year_co2_median is None and found[None].above_class_year_median == 0
    assert float(found["a"].class_year_co2_p25) == 7.0


def test_benchmarks_rank_with_gaps(fact):
    classes = {(r.model_year, r.vehicle_class): r for r in B.class_benchmark(fact).collect()}
    assert classes[1997, "VAN"].high_to_low_emission_rank == 1
    assert classes[1997, "SUV"].high_to_low_emission_rank == 2
    assert classes[2022, "VAN"].p25_co2_g_km == Decimal("210.0000000")
    makes = {(r.model_year, r.make): r.low_to_high_emission_rank for r in B.make_benchmark(fact).collect()}
    assert [makes[2022, m] for m in "ABC"] == [1, 2, 3]
    stats = {(r.model_year, r.vehicle_class): r for r in B.class_year_stats(fact).collect()}
    assert (stats[2022, "VAN"].median_co2_g_km, stats[2022, "VAN"].p25_co2_g_km) == (220.0, 210.0)


def test_latest_period(fact):
    assert [tuple(r)[:2] for r in B.latest_class_rank(fact).collect()] == [("VAN", 4)]
    ranked = B.latest_make_rank(fact, min_records=2).collect()
    assert [(r.make, r.low_emission_rank) for r in ranked] == [("B", 1)]


def test_shares_and_bands(fact):
    shares = {(r.model_year, r.fuel_type): r.record_share for r in B.fuel_mix_share(fact, "fuel_type").collect()}
    assert shares[1995, "X"] == Decimal("0.6667") and shares[2022, None] == Decimal("0.2500")
    from ratingloom.functions.numeric import bucketize

    band = bucketize("engine_size_l", S.ENGINE_EDGES, S.ENGINE_LABELS, null_label=">4.0L")
    assert [r.engine_size_band for r in B.engine_band_case(fact, band).collect()] == S.ENGINE_LABELS


def test_group_summaries_leave_unknown_keys_out(fact):
    found = B.group_summaries(fact, {"fuel": ["model_year", "fuel_type"]})["fuel"]
    assert sum(r.vehicle_records for r in found.collect()) == 8


def plan(df, step="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), step)().toString()


def test_unknown_keys_are_left_out_after_the_grouping(fact):
    """A filter on derived keys must not be pushed down to where it repeats their derivation for every row."""
    derived = fact.withColumn("fuel_type", F.upper(F.regexp_replace("fuel_type", "[0-9]", "")))
    found = B.group_summaries(derived, {"s": ["model_year", "fuel_type"]})["s"]
    assert plan(found).count("regexp_replace") == 1


def test_lookups_and_peers_are_broadcast(spark, fact):
    """The planner does not know how few rows they have and would move every row of the fact table."""
    lookup = spark.createDataFrame([("Diesel", "D")], "fuel_type string, fuel_type_code string")
    assert "broadcast" in plan(J.decode_join(spark.range(2).select(F.lit("Diesel").alias("fuel_type")), lookup, "fuel_type"), "analyzed").lower()
    rows = fact.select("model_year", "vehicle_class", B.EMISSIONS).coalesce(1)
    assert "broadcast" in plan(B.peer_benchmark(rows, ["model_year", "vehicle_class"], B.EMISSIONS), "analyzed").lower()


def test_mix_reads_its_rows_once(spark):
    reads = spark.sparkContext.accumulator(0)

    def seen(key):
        reads.add(1)
        return key

    rows = spark.createDataFrame([("a", 3), ("b", 2), ("c", 1)], "k string, n int").coalesce(1)
    watched = rows.withColumn("k", F.udf(seen, "string").asNondeterministic()("k"))
    assert sorted(map(tuple, K.category_mix(watched, "k", "n", 2).collect())) == [("Other", 3), ("a", 3)]
    assert reads.value == 3


def test_cube_rolls_up_to_the_detail_average(fact):
    cube = K.segment_summary(fact).cache()
    assert cube.count() == 9
    rolled = {r.make: r for r in K.aggregate_weighted(cube, ["make"], ["average_co2_g_km"]).collect()}
    detail = {r.make: r for r in fact.groupBy("make").agg(F.avg("co2_emissions_g_km").alias("m"), F.count("*").alias("n")).collect()}
    for make, row in rolled.items():
        assert (row.vehicle_records, row.average_co2_g_km) == (detail[make].n, pytest.approx(detail[make].m, abs=1e-4))
    kpis = K.segment_kpis(cube).first()
    assert (kpis.vehicle_configurations, kpis.model_years) == (9, 3)
    nothing = K.segment_kpis(cube.where("make = 'Q'")).first()
    assert (nothing.vehicle_configurations, nothing.average_co2_g_km, nothing.model_years) == (0, None, 0)


def test_weighted_averages_differ_on_unknown_values(spark):
    df = spark.createDataFrame([("a", 10.0, 1), ("a", None, 3), (None, 4.0, 2)], "k string, v double, vehicle_records int")
    only = df.where("k = 'a'")
    assert K.weighted_average(only, "v").first().v == 10.0
    grouped = {r.k: r for r in K.aggregate_weighted(df, ["k"], ["v"]).collect()}
    assert (grouped["a"].v, grouped["a"].vehicle_records) == (2.5, 4)
    assert grouped[None].v == 4.0
    zero = df.withColumn("vehicle_records", F.lit(0))
    assert K.weighted_average(zero, "v").first().v is None


def test_filters(fact):
    assert K.filter_segments(fact).count() == 9
    assert K.filter_segments(fact, (1995, 1997), ["SUV"], [], ["A"]).count() == 3
    assert K.search(fact, "").count() == 9
    assert K.search(fact, "FIV").count() == 1
    assert P.Filters((1995, 2022), text="b", fuels=["Z"]).apply(fact).count() == 3


def test_mix_folds_only_beyond_the_limit(spark):
    def mixed(n, limit=3):
        df = spark.createDataFrame([(f"k{i}", 10 - min(i, 3)) for i in range(n)] + [(None, 99)], "k string, v int")
        return sorted((tuple(r) for r in K.category_mix(df, "k", "v", limit).collect()))

    assert mixed(3) == [("k0", 10), ("k1", 9), ("k2", 8)]
    assert mixed(4) == [("Other", 15), ("k0", 10), ("k1", 9)]
    assert mixed(6, limit=5) == [("Other", 14), ("k0", 10), ("k1", 9), ("k2", 8), ("k3", 7)]
    assert mixed(0) == []


def test_guard_falls_back_to_all(spark):
    df = spark.createDataFrame([("a", 4), ("b", 6), ("c", 5)], "k string, vehicle_records int")
    assert sorted(r.k for r in K.guard_or_all(df, 5).collect()) == ["b", "c"]
    assert sorted(r.k for r in K.guard_or_all(df, 7).collect()) == ["a", "b", "c"]


def test_histogram_keeps_the_maximum_in_the_last_bin(spark):
    df = spark.range(0, 19).select(F.col("id").cast("double").alias("x"))
    found = {r.bin: r.configurations for r in K.histogram(df, "x", 18).collect()}
    assert sum(found.values()) == 19 and max(found) == 18 and found[18] == 2
    flat = K.histogram(spark.createDataFrame([(2.0,), (2.0,)], "x double"), "x").collect()
    assert [(r.bin, r.configurations) for r in flat] == [(1, 2)]


def test_one_row_attachment(spark):
    df, one = spark.range(3), spark.createDataFrame([(5, "x")], "a int, b string")
    assert [tuple(r) for r in J.with_one_row(df, one).orderBy("id").collect()] == [(i, 5, "x") for i in range(3)]
    assert J.with_one_row(df, one.where("a > 9")).count() == 0
    with pytest.raises(Exception, match="SCALAR_SUBQUERY_TOO_MANY_ROWS"):
        J.with_one_row(df, one.unionByName(one)).collect()


def test_opportunities(fact):
    ranked = {r.vehicle_id: r.within_class_opportunity_rank for r in X.ranked_opportunities(fact).collect()}
    assert ranked == {9: 1, 7: 2, 8: 2}
    assert {r.vehicle_id for r in X.opportunities(fact).collect()} == set(ranked)
    assert [r.vehicle_id for r in X.top_opportunities(fact, n=3).collect()] == [9, 7, 8]
    assert [r.vehicle_id for r in X.top_opportunities(fact).collect()] == [9, 7, 8, 6]
    assert [r.vehicle_id for r in X.opportunity_quartile(fact).collect()] == [9]
    labels = X.top_gap_labels(X.opportunities(fact), 2).collect()
    assert [r.vehicle_label for r in labels] == ["B — five", "C — seven"]


def test_scenarios(fact):
    view = X.opportunities(fact)
    found = X.scenario(view, 20_000, 1_000).first()
    gap = (90 + 10 + 10) / 3
    assert (found.configurations_screened, found.average_gap) == (3, pytest.approx(gap))
    assert found.scenario_tonnes == pytest.approx(gap * 20)
    steps = X.sensitivity(view).orderBy("annual_km").collect()
    assert [r.annual_km for r in steps] == list(range(5_000, 50_001, 5_000))
    assert steps[3].scenario_tonnes == pytest.approx(found.scenario_tonnes)
    assert X.scenario(view.where("false")).first().scenario_tonnes is None


def test_pages(fact):
    cube, bands = K.segment_summary(fact), K.engine_band_summary(fact.withColumn("engine_size_band", F.lit(">4.0L")))
    page = P.overview(cube, bands, P.Filters())
    assert [r.model_year for r in page["trend"].collect()] == [1995, 1997, 2022]
    assert page["engine_bands"].first().bubble_size == 80.0
    assert [r.vehicle_class for r in page["classes"].collect()] == ["SUV", "VAN"]
    segment = P.segments_page(cube, P.Filters((1995, 2022)))
    assert sorted(r.make for r in segment["makes"].collect()) == ["A", "B", "C"]
    assert [r.make for r in segment["make_ranking"].collect()] == ["C", "B", "A"]
    assert sum(r.vehicle_records for r in segment["class_mix"].collect()) == 9
    scenario = P.opportunity_page(X.opportunities(fact), P.Filters(classes=["VAN"]))
    assert scenario["kpis"].first().configurations_screened == 3
    assert sum(r.configurations for r in scenario["distribution"].collect()) == 3
