"""Small literal tables: lookups, data dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ratingloom.sources.schema import COLUMN_MAP, FUEL_TYPES, LEAKY_COLUMNS, TRANSMISSION_FAMILIES


def lookup_table(spark: SparkSession, rows: dict[str, str], code: str, label: str) -> DataFrame:
    """A code table; a later entry for the same code replaces the earlier one."""
    return spark.createDataFrame(sorted(rows.items()), f"{code} string, {label} string")


def fuel_type_lookup(spark: SparkSession) -> DataFrame:
    return lookup_table(spark, FUEL_TYPES, "fuel_type_code", "fuel_type_name")


def transmission_family_lookup(spark: SparkSession) -> DataFrame:
    return lookup_table(
        spark, TRANSMISSION_FAMILIES, "transmission_family_code", "transmission_family_name"
    )


# how the columns that are no source column come about
_DERIVED = {
    "vehicle_id": "position 1..N in source order after exact duplicates are removed",
    "source_row_number": "line of the source file, the header being line 1",
    "vehicle_class": "vehicle_class_raw under one spelling",
    "transmission_family_code": "leading letters of transmission",
    "transmission_family": "name of transmission_family_code",
    "gear_count": "trailing digits of transmission, 0 without digits",
    "fuel_type": "name of fuel_type_code",
    "city_hwy_gap_l_100km": "fuel_cons_city_l_100km - fuel_cons_hwy_l_100km",
    "city_hwy_ratio": "fuel_cons_city_l_100km / fuel_cons_hwy_l_100km",
    "co2_per_comb_l": "co2_emissions_g_km / fuel_cons_comb_l_100km",
    "engine_size_band": "band of engine_size_l",
    "class_year_co2_median": "median of co2_emissions_g_km over model_year and vehicle_class",
    "class_year_co2_p25": "lower quartile of co2_emissions_g_km over model_year and vehicle_class",
    "co2_vs_class_year_median": "co2_emissions_g_km - class_year_co2_median",
    "co2_gap_to_class_p25": "co2_emissions_g_km - class_year_co2_p25, at least 0",
    "above_class_year_median": "1 where co2_emissions_g_km > class_year_co2_median",
    "city_below_highway_flag": "1 where fuel_cons_city_l_100km < fuel_cons_hwy_l_100km",
    "emission_band": "band of co2_emissions_g_km",
    "model_split": "train, validation or test by model_year",
}


def _role(name: str) -> str:
    if name in ("vehicle_id", "source_row_number"):
        return "identifier"
    if name == "co2_emissions_g_km":
        return "target"
    if name in LEAKY_COLUMNS:
        return "withheld from the model"
    return "source" if name in COLUMN_MAP.values() else "derived"


def data_dictionary(clean: DataFrame) -> DataFrame:
    """Field, type, meaning and role of every column of a clean table, in table order."""
    source = {field: header for header, field in COLUMN_MAP.items()}
    rows = [
        (at, f.name, f.dataType.simpleString(), _DERIVED.get(f.name) or f"source column {source[f.name]}", _role(f.name))
        for at, f in enumerate(clean.schema.fields, start=1)
    ]
    kind = "position int, field string, data_type string, definition string, analytical_role string"
    return clean.sparkSession.createDataFrame(rows, kind)
