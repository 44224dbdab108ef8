"""Contracts of the ratings tables."""

from __future__ import annotations

from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

# --- fixed values: source header, code labels, class labels, band edges, period cuts -----------------

COLUMN_MAP = {
    "ModelYear": "model_year",
    "Make": "make",
    "Model": "model",
    "VehicleClass": "vehicle_class_raw",
    "EngineSize_L": "engine_size_l",
    "Cylinders": "cylinders",
    "Transmission": "transmission",
    "FuelType": "fuel_type_code",
    "FuelConsCity_L100km": "fuel_cons_city_l_100km",
    "FuelConsHwy_L100km": "fuel_cons_hwy_l_100km",
    "Comb_L100km": "fuel_cons_comb_l_100km",
    "Comb_mpg": "fuel_economy_comb_mpg",
    "CO2Emission_g_km": "co2_emissions_g_km",
    "CO2Rating": "co2_rating",
    "SmogRating": "smog_rating",
}

FUEL_TYPES = {
    "X": "Regular Gasoline",
    "Z": "Premium Gasoline",
    "D": "Diesel",
    "E": "E85",
    "N": "Natural Gas",
}

TRANSMISSION_FAMILIES = {
    "A": "Automatic",
    "AS": "Automatic with Select Shift",
    "AM": "Automated Manual",
    "AV": "Continuously Variable",
    "M": "Manual",
}

VEHICLE_CLASSES = {
    "COMPACT": "COMPACT",
    "FULL SIZE": "FULL-SIZE",
    "MID SIZE": "MID-SIZE",
    "MINICOMPACT": "MINICOMPACT",
    "MINIVAN": "MINIVAN",
    "PICKUP TRUCK SMALL": "PICKUP TRUCK - SMALL",
    "PICKUP TRUCK STANDARD": "PICKUP TRUCK - STANDARD",
    "SPECIAL PURPOSE VEHICLE": "SPECIAL PURPOSE VEHICLE",
    "STATION WAGON MID SIZE": "STATION WAGON - MID-SIZE",
    "STATION WAGON SMALL": "STATION WAGON - SMALL",
    "SUBCOMPACT": "SUBCOMPACT",
    "SUV": "SUV - UNSPECIFIED",
    "SUV SMALL": "SUV - SMALL",
    "SUV STANDARD": "SUV - STANDARD",
    "TWO SEATER": "TWO-SEATER",
    "VAN CARGO": "VAN - CARGO",
    "VAN PASSENGER": "VAN - PASSENGER",
    "UL": "OTHER / UNCLASSIFIED",
}

ENGINE_EDGES = [2.0, 3.0, 4.0]
ENGINE_LABELS = ["<=2.0L", "2.1-3.0L", "3.1-4.0L", ">4.0L"]
EMISSION_EDGES = [200, 250, 300, 350]
EMISSION_LABELS = ["<200", "200-249", "250-299", "300-349", "350+"]

FIRST_YEAR, LAST_YEAR = 1995, 2023
BASE_YEAR = 1995
TRAIN_UNTIL, VALIDATE_UNTIL = 2019, 2021
RECENT_SINCE = 2022
RATING_RANGE = (1, 10)
BLEND_WEIGHTS = (0.55, 0.45)
BLEND_TOLERANCE = 0.11

CLEAN_COLUMNS = [
    "vehicle_id",
    "source_row_number",
    "model_year",
    "make",
    "model",
    "vehicle_class_raw",
    "vehicle_class",
    "engine_size_l",
    "cylinders",
    "transmission",
    "transmission_family_code",
    "transmission_family",
    "gear_count",
    "fuel_type_code",
    "fuel_type",
    "fuel_cons_city_l_100km",
    "fuel_cons_hwy_l_100km",
    "fuel_cons_comb_l_100km",
    "fuel_economy_comb_mpg",
    "co2_emissions_g_km",
    "co2_rating",
    "smog_rating",
    "city_hwy_gap_l_100km",
    "city_hwy_ratio",
    "co2_per_comb_l",
    "engine_size_band",
    "class_year_co2_median",
    "class_year_co2_p25",
    "co2_vs_class_year_median",
    "co2_gap_to_class_p25",
    "above_class_year_median",
    "city_below_highway_flag",
    "emission_band",
    "model_split",
]

REQUIRED_COLUMNS = [
    "vehicle_id",
    "model_year",
    "make",
    "model",
    "vehicle_class",
    "engine_size_l",
    "cylinders",
    "transmission_family_code",
    "transmission_family",
    "fuel_type_code",
    "fuel_type",
    "fuel_cons_city_l_100km",
    "fuel_cons_hwy_l_100km",
    "fuel_cons_comb_l_100km",
    "co2_emissions_g_km",
]

# measured or target-derived columns that must not reach the early-specification model
LEAKY_COLUMNS = [
    "fuel_cons_city_l_100km",
    "fuel_cons_hwy_l_100km",
    "fuel_cons_comb_l_100km",
    "fuel_economy_comb_mpg",
    "co2_rating",
    "smog_rating",
    "class_year_co2_median",
    "class_year_co2_p25",
    "co2_vs_class_year_median",
    "co2_gap_to_class_p25",
    "above_class_year_median",
    "emission_band",
    "co2_per_comb_l",
]

DETAIL_COLUMNS = [
    "vehicle_id",
    "model_year",
    "make",
    "model",
    "vehicle_class",
    "engine_size_l",
    "engine_size_band",
    "cylinders",
    "transmission_family",
    "gear_count",
    "fuel_type",
    "fuel_cons_city_l_100km",
    "fuel_cons_hwy_l_100km",
    "fuel_cons_comb_l_100km",
    "fuel_economy_comb_mpg",
    "co2_emissions_g_km",
    "co2_rating",
    "smog_rating",
    "class_year_co2_median",
    "class_year_co2_p25",
    "co2_vs_class_year_median",
    "co2_gap_to_class_p25",
    "above_class_year_median",
    "emission_band",
    "model_split",
    "model_name",
    "predicted_co2_g_km",
    "prediction_error_g_km",
    "absolute_error_g_km",
    "absolute_percentage_error",
    "predicted_emission_band",
    "high_error_flag",
]

# --- derived contracts -------------------------------------------------------------------------------

_INTEGERS = {"ModelYear", "Cylinders", "Comb_mpg", "CO2Emission_g_km"}
_DOUBLES = {"EngineSize_L", "FuelConsCity_L100km", "FuelConsHwy_L100km", "Comb_L100km", "CO2Rating", "SmogRating"}


def _raw_type(name: str):
    if name in _INTEGERS:
        return IntegerType()
    return DoubleType() if name in _DOUBLES else StringType()


RAW_SCHEMA = StructType([StructField(name, _raw_type(name), True) for name in COLUMN_MAP])

# the stored fact table carries codes only; names come back through the lookups
FACT_COLUMNS = [name for name in CLEAN_COLUMNS if name not in ("transmission_family", "fuel_type")]
