"""The ratings vocabulary over the driver tables, in Spark and in SQL.

A line item of a part plays one published rating: ship year is the model year, brand the make, part name
the model, part type the class, line number the cylinders, quantity and size the consumption, price the
emissions. Spelling varies by line status so that canonicalisation has work to do. Orders carry no column
of a rating and are not joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ratingloom.operators.benchmarks import peer_benchmark
from ratingloom.operators.cleaning import banded_columns, canonical_columns, derive_ratios, temporal_split
from ratingloom.operators.metrics import PREDICTION_COLUMNS, high_error_flag, scored_errors
from ratingloom.operators.ordering import row_position
from ratingloom.operators.joins import join_summary
from ratingloom.sources.readers import rename

# unique over all line items
TIE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
PEERS = ["model_year", "vehicle_class"]

TRAIN_UNTIL, VALIDATE_UNTIL = 1998, 1999
FIRST_YEAR, LAST_YEAR = 1995, 2001
SINCE = 2000
MODEL = "Class Line"

# part type: class spelled the newer way, class spelled the older way, canonical class
CLASSES = {
    "ECONOMY": ("COMPACT", "Compact", "COMPACT"),
    "SMALL": ("SUV - SMALL", "SUV: SMALL", "SUV - SMALL"),
    "MEDIUM": ("MID-SIZE", " Mid Size", "MID-SIZE"),
    "LARGE": ("PICKUP TRUCK - STANDARD", "PICKUP TRUCK: STANDARD", "PICKUP TRUCK - STANDARD"),
    "PROMO": ("TWO-SEATER", "TWO-SEATER ", "TWO-SEATER"),
    "STANDARD": ("SUV - STANDARD", "SUV: STANDARD", "SUV - STANDARD"),
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


ITEM = [*TIE, "l_discount", "l_tax", "l_returnflag", "l_linestatus", "p_brand", "p_name", "p_type", "p_size"]


def _items(spark: SparkSession, folder: str) -> DataFrame:
    """What a raw rating is made of; one join, nothing else is shuffled."""
    items = table(spark, folder, "lineitem")
    parts = table(spark, folder, "part")
    return items.join(parts, items.l_partkey == parts.p_partkey).select(*ITEM)


def raw_ratings(spark: SparkSession, folder: str) -> DataFrame:
    """Fifteen raw columns and the tie-break columns."""
    return _raw(_items(spark, folder))


def numbered_raw(spark: SparkSession, folder: str, name: str, start: int = 1) -> DataFrame:
    """Raw ratings with their position by the tie-break columns; they are made after the items were moved to their places."""
    return _raw(row_position(_items(spark, folder), TIE, name=name, start=start), name)


def _raw(joined: DataFrame, *others: str) -> DataFrame:
    newer = F.col("l_linestatus") == "F"
    spelled = F.when(F.lit(False), F.lit(None).cast("string"))
    for kind, (new, old, _) in CLASSES.items():
        spelled = spelled.when(F.col("p_type") == kind, F.when(newer, F.lit(new)).otherwise(F.lit(old)))
    line, year = F.col("l_linenumber"), F.year("l_shipdate")
    family = (
        F.when(line <= 2, "A").when(line <= 4, "as").when(line == 5, "AM").when(line == 6, " M").otherwise("AV")
    )
    gears = F.when(line == 7, F.lit("")).otherwise((F.lit(3) + F.col("l_suppkey") % 8).cast("string"))
    fuel = F.when(F.col("l_returnflag") == "A", "X").when(F.col("l_returnflag") == "N", "Z").otherwise("D")
    city, highway = F.col("l_quantity").cast("decimal(5,1)"), F.col("p_size").cast("decimal(5,1)")
    blend = F.expr("round(0.55BD * cast(l_quantity as decimal(5,1)) + 0.45BD * cast(p_size as decimal(5,1)), 1)")
    combined = blend.cast("double")
    return joined.select(
        year.cast("int").alias("ModelYear"),
        F.when(newer, F.concat(F.lit(" "), F.col("p_brand"), F.lit("\t"))).otherwise(F.upper("p_brand")).alias("Make"),
        F.when(newer, F.replace("p_name", F.lit(" "), F.lit("  "))).otherwise(F.col("p_name")).alias("Model"),
        spelled.alias("VehicleClass"),
        (F.col("p_size") / 10).alias("EngineSize_L"),
        line.alias("Cylinders"),
        F.concat(family, gears).alias("Transmission"),
        F.when(newer, fuel).otherwise(F.lower(fuel)).alias("FuelType"),
        city.cast("double").alias("FuelConsCity_L100km"),
        highway.cast("double").alias("FuelConsHwy_L100km"),
        combined.alias("Comb_L100km"),
        F.floor(F.lit(2824.8) / combined).cast("int").alias("Comb_mpg"),
        F.floor(F.col("l_extendedprice") / 200).cast("int").alias("CO2Emission_g_km"),
        F.when(year >= 1999, F.nullif(F.round(F.col("l_discount") * 100), F.lit(0.0))).alias("CO2Rating"),
        F.when(year >= 2000, F.nullif(F.round(F.col("l_tax") * 100), F.lit(0.0))).alias("SmogRating"),
        *TIE,
        *others,
    )


def _canonical(raw: DataFrame) -> DataFrame:
    canonical = canonical_columns(rename(raw))
    return temporal_split(banded_columns(derive_ratios(canonical)), "model_year", TRAIN_UNTIL, VALIDATE_UNTIL)


def ratings(spark: SparkSession, folder: str) -> DataFrame:
    """Canonical, typed and banded ratings; row by row, unused columns are pruned."""
    return _canonical(raw_ratings(spark, folder))


def numbered_ratings(spark: SparkSession, folder: str) -> DataFrame:
    """Ratings with the dense position by the tie-break columns as vehicle id."""
    return _canonical(numbered_raw(spark, folder, "vehicle_id"))


def with_peers(df: DataFrame) -> DataFrame:
    return peer_benchmark(df, PEERS, "co2_emissions_g_km")


def fact(spark: SparkSession, folder: str) -> DataFrame:
    """Ratings with their peer columns."""
    return with_peers(ratings(spark, folder))


def numbered_fact(spark: SparkSession, folder: str) -> DataFrame:
    return with_peers(numbered_ratings(spark, folder))


def class_line(train: DataFrame, df: DataFrame, name: str = "prediction") -> DataFrame:
    """Emissions from city consumption by one least-squares line per class, fitted on ``train``."""
    city, emissions = F.col("fuel_cons_city_l_100km").cast("double"), F.col("co2_emissions_g_km").cast("double")
    lines = train.groupBy("vehicle_class").agg(
        F.regr_slope(emissions, city).alias("__slope"), F.regr_intercept(emissions, city).alias("__intercept")
    )
    joined = join_summary(df, lines, ["vehicle_class"])
    return joined.withColumn(name, F.col("__intercept") + F.col("__slope") * city).drop("__slope", "__intercept")


def class_mean(train: DataFrame, df: DataFrame, name: str = "prediction") -> DataFrame:
    means = train.groupBy("vehicle_class").agg(F.avg(F.col("co2_emissions_g_km").cast("double")).alias(name))
    return join_summary(df, means, ["vehicle_class"])


def errors(rows: DataFrame) -> DataFrame:
    """Every rating scored by the class lines of the training years, other columns kept."""
    scored = class_line(rows.where(F.col("model_year") <= TRAIN_UNTIL), rows)
    return scored_errors(scored, MODEL, "prediction", "co2_emissions_g_km")


def predictions(rows: DataFrame) -> DataFrame:
    """The errors with the high-error flag."""
    return high_error_flag(errors(rows))


def prediction_table(rows: DataFrame) -> DataFrame:
    return predictions(rows).select(*PREDICTION_COLUMNS)


# --- the same vocabulary in SQL ----------------------------------------------------------------------

_CLASS_SQL = " ".join(f"WHEN '{kind}' THEN '{names[2]}'" for kind, names in CLASSES.items())

RATINGS = f"""ratings AS (
  SELECT {', '.join(TIE)},
    year(l_shipdate) AS model_year, upper(p_brand) AS make, upper(p_name) AS model,
    CASE p_type {_CLASS_SQL} END AS vehicle_class,
    CAST(p_size / 10.0 AS DECIMAL(4,1)) AS engine_size_l,
    CASE WHEN p_size <= 20 THEN '<=2.0L' WHEN p_size <= 30 THEN '2.1-3.0L'
         WHEN p_size <= 40 THEN '3.1-4.0L' ELSE '>4.0L' END AS engine_size_band,
    l_linenumber AS cylinders,
    CASE WHEN l_linenumber <= 2 THEN 'A' WHEN l_linenumber <= 4 THEN 'AS' WHEN l_linenumber = 5 THEN 'AM'
         WHEN l_linenumber = 6 THEN 'M' ELSE 'AV' END AS transmission_family_code,
    CASE WHEN l_linenumber <= 2 THEN 'Automatic' WHEN l_linenumber <= 4 THEN 'Automatic with Select Shift'
         WHEN l_linenumber = 5 THEN 'Automated Manual' WHEN l_linenumber = 6 THEN 'Manual'
         ELSE 'Continuously Variable' END AS transmission_family,
    CASE WHEN l_linenumber = 7 THEN 0 ELSE 3 + l_suppkey % 8 END AS gear_count,
    CASE l_returnflag WHEN 'A' THEN 'X' WHEN 'N' THEN 'Z' ELSE 'D' END AS fuel_type_code,
    CASE l_returnflag WHEN 'A' THEN 'Regular Gasoline' WHEN 'N' THEN 'Premium Gasoline' ELSE 'Diesel' END AS fuel_type,
    CAST(l_quantity AS DECIMAL(5,1)) AS fuel_cons_city_l_100km,
    CAST(p_size AS DECIMAL(5,1)) AS fuel_cons_hwy_l_100km,
    CAST(round(CAST(0.55 AS DECIMAL(3,2)) * CAST(l_quantity AS DECIMAL(5,1))
             + CAST(0.45 AS DECIMAL(3,2)) * CAST(p_size AS DECIMAL(5,1)), 1) AS DECIMAL(5,1)) AS fuel_cons_comb_l_100km,
    CAST(floor(l_extendedprice / 200) AS BIGINT) AS co2_emissions_g_km,
    CASE WHEN year(l_shipdate) >= 1999 THEN nullif(CAST(round(l_discount * 100) AS BIGINT), 0) END AS co2_rating,
    CASE WHEN year(l_shipdate) >= 2000 THEN nullif(CAST(round(l_tax * 100) AS BIGINT), 0) END AS smog_rating,
    CASE WHEN floor(l_extendedprice / 200) < 200 THEN '<200' WHEN floor(l_extendedprice / 200) < 250 THEN '200-249'
         WHEN floor(l_extendedprice / 200) < 300 THEN '250-299' WHEN floor(l_extendedprice / 200) < 350 THEN '300-349'
         ELSE '350+' END AS emission_band,
    CASE WHEN year(l_shipdate) <= {TRAIN_UNTIL} THEN 'train' WHEN year(l_shipdate) <= {VALIDATE_UNTIL} THEN 'validation'
         ELSE 'test' END AS model_split
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

NUMBERED = f"""numbered AS (SELECT *, row_number() OVER (ORDER BY {', '.join(TIE)}) AS vehicle_id FROM ratings)"""

PEER_SQL = """peers AS (
  SELECT model_year, vehicle_class,
    CAST(quantile_cont(CAST(co2_emissions_g_km AS DOUBLE), 0.5) AS DECIMAL(18,3)) AS class_year_co2_median,
    CAST(quantile_cont(CAST(co2_emissions_g_km AS DOUBLE), 0.25) AS DECIMAL(18,3)) AS class_year_co2_p25
  FROM ratings GROUP BY ALL)"""

FACT = """fact AS (
  SELECT r.*, class_year_co2_median, class_year_co2_p25,
    co2_emissions_g_km - class_year_co2_median AS co2_vs_class_year_median,
    CASE WHEN co2_emissions_g_km > class_year_co2_p25 THEN co2_emissions_g_km - class_year_co2_p25
         ELSE 0 END AS co2_gap_to_class_p25,
    CASE WHEN co2_emissions_g_km > class_year_co2_median THEN 1 ELSE 0 END AS above_class_year_median
  FROM numbered AS r JOIN peers USING (model_year, vehicle_class))"""

LINES = f"""lines AS (
  SELECT vehicle_class,
    regr_slope(CAST(co2_emissions_g_km AS DOUBLE), CAST(fuel_cons_city_l_100km AS DOUBLE)) AS slope,
    regr_intercept(CAST(co2_emissions_g_km AS DOUBLE), CAST(fuel_cons_city_l_100km AS DOUBLE)) AS intercept
  FROM ratings WHERE model_year <= {TRAIN_UNTIL} GROUP BY vehicle_class)"""

SCORED = """scored AS (
  SELECT n.*, CAST(co2_emissions_g_km AS DOUBLE) AS actual_co2_g_km,
    CAST(round(intercept + slope * CAST(fuel_cons_city_l_100km AS DOUBLE), 3) AS DECIMAL(18,3)) AS predicted_co2_g_km
  FROM numbered AS n JOIN lines USING (vehicle_class))"""

ERRORS = f"""errors AS (
  SELECT *, model_split AS data_split, '{MODEL}' AS model_name,
    predicted_co2_g_km - co2_emissions_g_km AS prediction_error_g_km,
    abs(predicted_co2_g_km - co2_emissions_g_km) AS absolute_error_g_km,
    round_even(CAST(abs(predicted_co2_g_km - co2_emissions_g_km) AS DOUBLE) / co2_emissions_g_km, 6) AS absolute_percentage_error,
    CASE WHEN predicted_co2_g_km < 200 THEN '<200' WHEN predicted_co2_g_km < 250 THEN '200-249'
         WHEN predicted_co2_g_km < 300 THEN '250-299' WHEN predicted_co2_g_km < 350 THEN '300-349'
         ELSE '350+' END AS predicted_emission_band
  FROM scored)"""

FLAGGED = """flagged AS (
  SELECT *, CASE WHEN CAST(absolute_error_g_km AS DOUBLE) >= (
      SELECT quantile_cont(CAST(absolute_error_g_km AS DOUBLE), 0.9) FROM errors WHERE data_split = 'test')
    THEN 1 ELSE 0 END AS high_error_flag
  FROM errors)"""

BASE = (RATINGS,)
PEERED = (RATINGS, NUMBERED, PEER_SQL, FACT)
PREDICTED = (RATINGS, NUMBERED, LINES, SCORED, ERRORS, FLAGGED)
