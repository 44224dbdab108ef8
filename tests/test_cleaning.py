"""Readers, duplicate removal, canonical categories, the cleaning job and its audit."""

import pytest
from pyspark.sql import functions as F

from ratingloom.operators import cleaning as C, quality as Q
from ratingloom.operators.joins import fk_violations, pk_violations
from ratingloom.sources import readers as IN, schema as S, writers as OUT
from ratingloom.sources.literals import data_dictionary, fuel_type_lookup, lookup_table

HEADER = ",".join(S.COLUMN_MAP)
LINES = [
    "1995, Acura,INTEGRA ,COMPACT,1.8,4,A4,X,10.2,7.0,8.8,32,205,,",
    "1995,ACURA,INTEGRA,COMPACT,1.8,4,A4,X,10.2,7.0,8.8,32,205,,",
    "1995,ACURA,INTEGRA,COMPACT,1.8,4,A4,X,10.2,7.0,8.8,32,205,,",
    "1995,ACURA,LEGEND,compact,3.2,6,AV,Z,14.2,10.5,12.5,23,290,,",
    "2020,LAND  ROVER,DISCOVERY,SUV: STANDARD,4.1,8,as10,z,17.5,12.0,15.0,19,350,3,5",
    "2022,BMW,M3,Mid-Size,3.0,6,M6,Z,9.0,9.5,9.2,31,215,5,7",
]


@pytest.fixture(scope="module")
def csv(tmp_path_factory):
    path = tmp_path_factory.mktemp("raw") / "ratings.csv"
    path.write_text("\n".join([HEADER, *LINES]) + "\n")
    return str(path)


@pytest.fixture(scope="module")
def raw(spark, csv):
    from ratingloom.operators.ordering import natural_position

    return natural_position(IN.read_ratings(spark, csv)).cache()


@pytest.fixture(scope="module")
def cleaned(raw):
    return C.clean_ratings(raw).cache()


def test_reader_keeps_types_and_numbers_lines(spark, csv, raw):
    assert IN.read_ratings(spark, csv).schema == S.RAW_SCHEMA
    assert sorted(r.source_row_number for r in raw.collect()) == [2, 3, 4, 5, 6, 7]
    assert raw.where("source_row_number = 7").first().Model == "M3"


def test_header_contract(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text("Make,ModelYear\nA,1\n")
    with pytest.raises(ValueError):
        IN.read_ratings(spark, str(path))
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert IN.missing_columns(df, ["b", "z", "c"]) == ["c", "z"]
    with pytest.raises(ValueError):
        IN.require_columns(df, ["z"])


def test_malformed_number_fails(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text("\n".join([HEADER, LINES[1].replace("1995", "soon")]) + "\n")
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|Malformed"):
        IN.read_ratings(spark, str(path)).collect()


def test_numeric_casts(spark):
    df = spark.createDataFrame([("1.5",), ("x",), (None,)], "n string")
    lenient = IN.to_numeric(df, {"n": "double"}, errors="coerce")
    assert [r.n for r in lenient.collect()] == [1.5, None, None]
    with pytest.raises(Exception, match="n is not numeric: x"):
        IN.to_numeric(df, {"n": "double"}).collect()
    strict = IN.to_numeric(df.where("n is null or n <> 'x'"), {"n": "double"})
    assert [r.n for r in strict.collect()] == [1.5, None]


def test_duplicates_are_exact_and_first_stays(raw):
    kept, removed = C.split_exact_duplicates(raw, list(S.COLUMN_MAP), "source_row_number")
    assert sorted(r.source_row_number for r in kept.collect()) == [2, 3, 5, 6, 7]
    assert [r.source_row_number for r in removed.collect()] == [4]


def test_duplicates_with_nulls_and_other_columns(spark):
    df = spark.createDataFrame(
        [(1, "a", None, "p"), (2, "a", None, "q"), (3, "A", None, "r"), (4, None, None, "s"), (5, None, None, "t")],
        "id int, x string, y double, note string",
    )
    kept, removed = C.split_exact_duplicates(df, ["x", "y"], "id")
    assert sorted(r.note for r in kept.collect()) == ["p", "r", "s"]
    assert sorted(r.note for r in removed.collect()) == ["q", "t"]


def test_hot_group_of_copies(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("v"))
    kept, removed = C.split_exact_duplicates(df, ["v"], "id")
    assert (kept.count(), removed.count()) == (2001, 999)


def test_unknown_class_is_named(spark):
    df = spark.createDataFrame([("SUV",), ("HOVERCRAFT",)], "c string")
    assert C.canonicalize(df.where("c = 'SUV'"), "c", S.VEHICLE_CLASSES, "k").first().k == "SUV - UNSPECIFIED"
    with pytest.raises(Exception, match="Unmapped vehicle class: HOVERCRAFT"):
        C.canonicalize(df, "c", S.VEHICLE_CLASSES, "k").collect()
    nothing = spark.createDataFrame([(None,)], "c string")
    with pytest.raises(Exception, match="Unmapped vehicle class: null"):
        C.canonicalize(nothing, "c", S.VEHICLE_CLASSES, "k").collect()


def test_every_label_is_its_own_canonical_form(spark):
    labels = [v for v in S.VEHICLE_CLASSES.values() if v not in ("SUV - UNSPECIFIED", "OTHER / UNCLASSIFIED")]
    df = spark.createDataFrame([(v,) for v in labels], "c string")
    assert all(r.c == r.k for r in C.canonicalize(df, "c", S.VEHICLE_CLASSES, "k").collect())


def test_clean_table(cleaned):
    assert cleaned.columns == S.CLEAN_COLUMNS
    rows = {r.source_row_number: r for r in cleaned.collect()}
    assert [rows[n].vehicle_id for n in (2, 3, 5, 6, 7)] == [1, 2, 3, 4, 5]
    land, legend, sport = rows[6], rows[5], rows[7]
    assert (land.make, land.vehicle_class, land.transmission_family, land.gear_count, land.fuel_type) == (
        "LAND ROVER", "SUV - STANDARD", "Automatic with Select Shift", 10, "Premium Gasoline",
    )
    assert (land.engine_size_band, land.emission_band, land.model_split, land.co2_rating) == (">4.0L", "350+", "validation", 3)
    assert (legend.vehicle_class_raw, legend.vehicle_class, legend.gear_count) == ("compact", "COMPACT", 0)
    assert (float(legend.class_year_co2_median), float(legend.class_year_co2_p25)) == (205.0, 205.0)
    assert (float(legend.co2_vs_class_year_median), float(legend.co2_gap_to_class_p25)) == (85.0, 85.0)
    assert (legend.above_class_year_median, rows[3].above_class_year_median) == (1, 0)
    assert (sport.city_below_highway_flag, float(sport.city_hwy_gap_l_100km), float(sport.city_hwy_ratio)) == (1, -0.5, 0.947368)
    assert (sport.model_split, legend.co2_rating) == ("test", None)


def test_audit_of_the_clean_table(raw, cleaned):
    counts = Q.enforce(Q.dq_checks(cleaned))
    assert len(counts) == 14
    assert (counts["clean_rows"], counts["city_below_highway_rows"]) == (5, 1)
    log = [tuple(r)[1:] for r in C.cleaning_log(raw, list(S.COLUMN_MAP), "source_row_number").orderBy("position").collect()]
    assert [r[1:4] for r in log] == [(6, 6, 0), (6, 5, 1), (5, 5, 0)]
    report = Q.audit_report(raw, cleaned).first()
    assert (report.source_rows, report.source_columns) == (6, 15)
    assert (report.clean_rows, report.rows_removed_as_exact_duplicates) == (5, 1)
    assert report.validation_checks.clean_rows == 5
    assert {r.column_name: r.missing_values for r in report.missing_values}["CO2Rating"] == 4
    assert report.rating_availability.co2_rating_first_year == 2020


def test_rule_counts_treat_nulls_apart(spark, cleaned):
    def broken(**changes):
        row = cleaned.limit(1)
        for name, value in changes.items():
            row = row.withColumn(name, F.lit(value).cast(dict(cleaned.dtypes)[name]))
        return Q.dq_checks(row).first()

    found = broken(model_year=None)
    assert (found.invalid_model_year, found.missing_required_values) == (1, 1)
    found = broken(engine_size_l=None)
    assert (found.invalid_engine_size, found.missing_required_values) == (0, 1)
    assert [broken(co2_rating=v).invalid_co2_rating for v in (0, 11, None, 10)] == [1, 1, 0, 0]
    assert broken(fuel_cons_city_l_100km=0).invalid_consumption == 1
    with pytest.raises(AssertionError, match="invalid_co2"):
        Q.enforce(Q.dq_checks(cleaned.withColumn("co2_emissions_g_km", F.lit(0))))


def test_profiles(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, None), (3.0, 3), (100.0, 3), (None, None)], "a double, b int")
    found = {r.column_name: r for r in Q.numeric_profile(df).collect()}
    assert tuple(found["a"])[1:] == (4, 1.0, 100.0, 26.5, 2.5)
    assert tuple(found["b"])[1:4] == (3, 1.0, 3.0)
    beyond = Q.iqr_outliers(df, ["a"]).first()
    # quartiles 1.75 and 27.25 leave bounds -36.5 and 65.5
    assert (beyond.lower_bound, beyond.upper_bound, beyond.outlier_rows) == (-36.5, 65.5, 1)
    assert {r.column_name: r.missing_values for r in Q.missing_counts(df).collect()} == {"a": 1, "b": 2}
    assert {r.column_name: r.distinct_values for r in Q.cardinalities(df, {"a": "a", "b": "b"}).collect()} == {"a": 4, "b": 2}
    assert [r.data_type for r in IN.source_types(df).collect()] == ["double", "int"]


def test_line_fit_has_no_r2_on_a_constant_target(spark):
    df = spark.createDataFrame(
        [("c", 1.0, 5.0), ("c", 2.0, 5.0), ("l", 1.0, 3.0), ("l", 2.0, 5.0), ("l", 4.0, 9.0), (None, 1.0, 1.0)],
        "k string, x double, y double",
    )
    found = {r.k: r for r in Q.group_ols(df, "k", "x", "y").collect()}
    assert set(found) == {"c", "l"}
    assert found["c"].r_squared is None
    assert (found["l"].slope, found["l"].intercept, found["l"].r_squared) == pytest.approx((2.0, 1.0, 1.0))


def test_shares_and_correlation(cleaned):
    assert 0 <= Q.share_within(cleaned, "fuel_cons_comb_l_100km", *Q.CONSUMPTION[:2]).first()[0] <= 1
    assert Q.correlation(cleaned, "co2_emissions_g_km", "fuel_cons_comb_l_100km").first()[0] > 0.9


def test_integrity(spark):
    parent = spark.createDataFrame([(1,), (2,)], "id int")
    child = spark.createDataFrame([(1,), (3,), (3,), (None,)], "pid int")
    assert tuple(fk_violations(child, parent, "pid", "id", "c").first()) == ("c", 1, 2)
    assert tuple(pk_violations(child, ["pid"], "p").first()) == ("p", 1, 2)
    assert tuple(pk_violations(parent, ["id"], "p").first()) == ("p", 0, 0)


def test_load_verifies(spark, cleaned, tmp_path):
    bad = F.col("co2_emissions_g_km") <= 0
    table = OUT.load_table(cleaned, str(tmp_path / "t"), S.FACT_COLUMNS, "vehicle_id", bad)
    assert (table.count(), table.columns) == (5, S.FACT_COLUMNS)
    with pytest.raises(AssertionError):
        OUT.load_table(cleaned.unionByName(cleaned), str(tmp_path / "u"), S.FACT_COLUMNS, "vehicle_id", bad)
    with pytest.raises(ValueError):
        OUT.load_table(cleaned, str(tmp_path / "v"), ["nope"], "vehicle_id", bad)


def test_exports_and_manifest(spark, cleaned, tmp_path):
    import hashlib

    folder = str(tmp_path / "out")
    frames = {"clean": cleaned.orderBy("vehicle_id"), "dictionary": data_dictionary(cleaned)}
    written = OUT.export_all(frames, folder)
    found = {r.file: r for r in OUT.manifest(spark, folder, frames, written).collect()}
    assert (found["clean"].rows, found["clean"].columns) == (5, 34)
    assert (found["dictionary"].rows, found["dictionary"].columns) == (34, 5)
    part = next((tmp_path / "out" / "clean").glob("part-*"))
    part_hash = hashlib.sha256(part.read_bytes()).hexdigest()
    assert found["clean"].sha256 == hashlib.sha256(part_hash.encode()).hexdigest()
    assert found["clean"].bytes == part.stat().st_size


def test_lookup_replaces(spark, cleaned):
    assert fuel_type_lookup(spark).count() == 5
    assert lookup_table(spark, {**{"X": "old"}, **{"X": "new"}}, "c", "n").first().n == "new"
    assert [r.field for r in data_dictionary(cleaned).orderBy("position").collect()] == S.CLEAN_COLUMNS


def test_wide_stages_are_left_unfused_in_any_session(spark):
    limit = "spark.sql.codegen.hugeMethodLimit"
    for given, kept in (("65535", "7000"), ("6000", "6000")):
        other = spark.newSession()
        other.conf.set(limit, given)
        C.canonical_columns(IN.rename(other.createDataFrame([], ", ".join(f"{name} string" for name in S.COLUMN_MAP))))
        assert other.conf.get(limit) == kept


def test_only_rows_whose_digest_recurs_are_grouped(spark, monkeypatch):
    rows = [(1, "a", 0.0), (2, "a", -0.0), (3, "a", 1.0), (4, None, 1.0), (5, None, 1.0), (6, "b", None), (7, "c", float("nan")), (8, "c", float("nan"))]
    df = spark.createDataFrame(rows, "id long, t string, x double")
    grouped, group = [], C.first_of_copies
    monkeypatch.setattr(C, "first_of_copies", lambda df, *a: grouped.append(df.count()) or group(df, *a))
    kept, removed = C.split_exact_duplicates(df, ["t", "x"], "id")
    assert sorted(r.id for r in kept.collect()) == [1, 3, 4, 6, 7] and sorted(r.id for r in removed.collect()) == [2, 5, 8]
    assert grouped == [6]
    monkeypatch.setattr(C, "SUMMARY_ROWS", 0)
    kept, removed = C.split_exact_duplicates(df, ["t", "x"], "id")
    assert sorted(r.id for r in kept.collect()) == [1, 3, 4, 6, 7] and grouped == [6, 8]
