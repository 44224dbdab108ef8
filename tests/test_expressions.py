"""Column expressions on hand-written edge values."""

import pytest
from pyspark.sql import functions as F

from ratingloom.functions import numeric as N, text as T
from ratingloom.sources import schema as S


def values(spark, kind, items, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_bands_follow_their_closed_side(spark):
    engine = N.bucketize("x", S.ENGINE_EDGES, S.ENGINE_LABELS)
    assert values(spark, "double", [2.0, 2.1, 3.0, 4.0, 4.1, None], engine) == [
        "<=2.0L", "2.1-3.0L", "2.1-3.0L", "3.1-4.0L", ">4.0L", None,
    ]
    emission = N.bucketize("x", S.EMISSION_EDGES, S.EMISSION_LABELS, right=False)
    assert values(spark, "double", [199.9, 200.0, 250.0, 349.9, 350.0, None], emission) == [
        "<200", "200-249", "250-299", "300-349", "350+", None,
    ]


def test_case_band_sends_null_to_the_last_label(spark):
    expr = N.bucketize("x", S.ENGINE_EDGES, S.ENGINE_LABELS, null_label=">4.0L")
    assert values(spark, "double", [None, 1.0], expr) == [">4.0L", "<=2.0L"]


def test_bands_need_matching_labels():
    with pytest.raises(ValueError):
        N.bucketize("x", [1, 2], ["a", "b"])


def test_ratio_of_zero_is_null_and_rounding_rules_differ(spark):
    assert values(spark, "double", [0.0, 2.0], N.safe_ratio(F.lit(1.0), "x")) == [None, 0.5]
    assert values(spark, "double", [0.5, 1.5, 2.5, -2.5], N.half_even("x", 0)) == [0.0, 2.0, 2.0, -2.0]
    assert values(spark, "double", [2.5], F.round("x", 0)) == [3.0]
    assert values(spark, "double", [12.8515625, 0.6454125], N.half_even("x", 6)) == [12.851562, 0.645412]


def test_null_rules_of_range_checks(spark):
    items = [None, 0, 1, 10, 11]
    assert values(spark, "int", items, N.outside("x", 1, 10)) == [True, True, False, False, True]
    assert values(spark, "int", items, N.any_of(["x"], lambda c: c <= 0)) == [False, True, False, False, False]
    assert values(spark, "int", [None, -1, 5], N.clip_lower("x")) == [None, 0, 5]
    assert values(spark, "int", [None, 5], N.flag(F.col("x") > 1)) == [0, 1]


def test_band_around_columns_includes_its_edge(spark):
    df = spark.createDataFrame(
        [(1, 10.0, 8.0, 10.11), (2, 10.0, 8.0, 10.12), (3, 10.0, 8.0, 7.89), (4, 10.0, 8.0, 7.88), (5, 10.0, 8.0, None)],
        "i int, a double, b double, c double",
    ).select("i", *[F.col(n).cast("decimal(6,2)").alias(n) for n in "abc"])
    from decimal import Decimal

    found = df.orderBy("i").select(N.outside_band("c", ["a", "b"], Decimal("0.11"))).collect()
    assert [r[0] for r in found] == [False, True, False, True, True]


def test_finite(spark):
    assert values(spark, "double", [1.0, float("nan"), float("inf"), -float("inf"), None], N.is_finite("x")) == [
        True, False, False, False, False,
    ]


def test_percentage_error_floors_a_zero_target(spark):
    assert values(spark, "double", [0.0, 4.0], N.floored_percentage_error(F.lit(-2.0), "x")) == [
        2.0 / N.MACHINE_EPSILON, 0.5,
    ]


def test_text_is_stripped_of_every_whitespace(spark):
    items = ["\t land   rover\n", "a\x1cb", "", None, "ALFA  ROMEO"]
    assert values(spark, "string", items, T.normalize_text("x")) == ["LAND ROVER", "A B", "", None, "ALFA ROMEO"]


def test_codes_and_numbers_from_text(spark):
    codes = ["AS10", "AV", "6M", "M5", None, "A99999999999"]
    assert values(spark, "string", codes, T.leading_letters("x")) == ["AS", "AV", None, "M", None, "A"]
    assert values(spark, "string", codes, T.trailing_number("x")) == [10, 0, 0, 5, 0, 0]
    assert values(spark, "string", codes[:2], T.trailing_number("x", None)) == [10, None]


def test_search_is_literal(spark):
    df = spark.createDataFrame([("A.B", "x"), ("AXB", None), (None, "a.b c")], "make string, model string")
    assert df.where(T.contains_literal(["make", "model"], "a.B")).count() == 2
    assert df.where(T.contains_literal(["make"], "a.B")).count() == 1


def test_labels(spark):
    assert values(spark, "string", ["vehicle_class"], T.title_label("x")) == ["Vehicle Class"]
    assert values(spark, "string", ["b", None], T.joined_label("x", "x")) == ["b — b", None]
    order = values(spark, "string", [">4.0L", "<=2.0L", "else"], N.label_position("x", S.ENGINE_LABELS))
    assert order == [4, 1, 5]
    assert values(spark, "string", ["X", "Q"], T.decode("x", S.FUEL_TYPES)) == ["Regular Gasoline", None]


def test_period_labels(spark):
    assert values(spark, "int", [2019, 2020, 2021, 2022], N.period_label("x", 2019, 2021)) == [
        "train", "validation", "validation", "test",
    ]


def test_normalised_text_mentions_its_source_once(spark):
    """Filters pushed below a derivation copy it, so every further mention multiplies with the next one."""
    made = spark.range(1).select(T.normalize_text(F.reverse(F.col("id").cast("string"))).alias("t"))
    assert made._jdf.queryExecution().analyzed().toString().count("reverse(") == 1
