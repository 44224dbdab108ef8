"""Scans, projections, cleaning and data-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratingloom.functions.numeric import bucketize
from ratingloom.functions.text import category_key, leading_letters, normalize_text, trailing_number
from ratingloom.operators import cleaning as C, quality as Q
from ratingloom.operators.joins import decode_join, fk_violations, pk_violations
from ratingloom.operators.metrics import stack
from ratingloom.operators.ordering import dense_key, row_position
from ratingloom.session import scratch_path
from ratingloom.sources import schema as S
from ratingloom.sources.literals import fuel_type_lookup, transmission_family_lookup
from ratingloom.sources.readers import to_numeric
from ratingloom.sources.writers import load_check, load_table
from registry import tables as R
from registry.catalog import query
from registry.tables import BASE, FACT, NUMBERED, PEER_SQL, PEERED, TIE, table

TIE_TEXT = "l_orderkey:l l_linenumber:l l_partkey:l l_suppkey:l l_quantity:d l_extendedprice:d"
TIE_LIST = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"

# --- row numbers and keys ----------------------------------------------------------------------------


@query(
    "source_row_number",
    f"source_row_number:l {TIE_TEXT}",
    f"SELECT 1 + row_number() OVER (ORDER BY {', '.join(TIE)}) AS source_row_number, {TIE_LIST} FROM lineitem",
)
def source_row_number(spark, folder):
    return row_position(table(spark, folder, "lineitem"), TIE, name="source_row_number", start=2)


@query(
    "surrogate_key",
    "vehicle_id:l doc_id:l lang:s source:s",
    """SELECT row_number() OVER (ORDER BY doc_id) AS vehicle_id, doc_id, lang, source
       FROM (SELECT min(doc_id) AS doc_id, lang, source FROM documents GROUP BY text, lang, source)""",
)
def surrogate_key(spark, folder):
    documents = table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    kept, _ = C.split_exact_duplicates(documents, ["text", "lang", "source"], "doc_id")
    return dense_key(kept, "doc_id")


# --- projections and expressions ---------------------------------------------------------------------


@query(
    "derived_ratios",
    f"{TIE_TEXT} city_hwy_gap_l_100km:d3 city_hwy_ratio:d co2_per_comb_l:d",
    f"""SELECT {TIE_LIST}, fuel_cons_city_l_100km - fuel_cons_hwy_l_100km AS city_hwy_gap_l_100km,
        round_even(CAST(fuel_cons_city_l_100km AS DOUBLE) / CAST(fuel_cons_hwy_l_100km AS DOUBLE), 6) AS city_hwy_ratio,
        round_even(co2_emissions_g_km / CAST(fuel_cons_comb_l_100km AS DOUBLE), 6) AS co2_per_comb_l FROM ratings""",
    BASE,
)
def derived_ratios(spark, folder):
    return R.ratings(spark, folder)


@query(
    "bucket_right",
    "engine_size_l:d engine_size_band:s n:l",
    "SELECT engine_size_l, engine_size_band, count(*) AS n FROM ratings GROUP BY ALL",
    BASE,
)
def bucket_right(spark, folder):
    band = bucketize("engine_size_l", S.ENGINE_EDGES, S.ENGINE_LABELS).alias("engine_size_band")
    return R.ratings(spark, folder).groupBy("engine_size_l", band).agg(F.count(F.lit(1)).alias("n"))


@query(
    "bucket_left",
    "co2_emissions_g_km:l emission_band:s n:l",
    "SELECT co2_emissions_g_km, emission_band, count(*) AS n FROM ratings GROUP BY ALL",
    BASE,
)
def bucket_left(spark, folder):
    band = bucketize("co2_emissions_g_km", S.EMISSION_EDGES, S.EMISSION_LABELS, right=False).alias("emission_band")
    return R.ratings(spark, folder).groupBy("co2_emissions_g_km", band).agg(F.count(F.lit(1)).alias("n"))


@query(
    "temporal_split",
    "model_year:l model_split:s n:l",
    "SELECT model_year, model_split, count(*) AS n FROM ratings GROUP BY ALL",
    BASE,
)
def temporal_split(spark, folder):
    rows = C.temporal_split(R.ratings(spark, folder), "model_year", R.TRAIN_UNTIL, R.VALIDATE_UNTIL)
    return rows.groupBy("model_year", "model_split").agg(F.count(F.lit(1)).alias("n"))


@query(
    "year_range_filter",
    f"model_year:l make:s {TIE_TEXT}",
    f"SELECT model_year, make, {TIE_LIST} FROM ratings WHERE model_year BETWEEN 1997 AND 1998",
    BASE,
)
def year_range_filter(spark, folder):
    return R.ratings(spark, folder).where(F.col("model_year").between(1997, 1998))


@query(
    "decode_labels",
    "fuel_type_code:s fuel_type:s transmission_family_code:s transmission_family:s n:l",
    """SELECT fuel_type_code, fuel_type, transmission_family_code, transmission_family, count(*) AS n
       FROM ratings GROUP BY ALL""",
    BASE,
)
def decode_labels(spark, folder):
    keys = ["fuel_type_code", "fuel_type", "transmission_family_code", "transmission_family"]
    return R.ratings(spark, folder).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


@query(
    "lookup_join",
    "fuel_type_name:s transmission_family_name:s n:l average_co2_g_km:d4",
    """SELECT fuel_type AS fuel_type_name, transmission_family AS transmission_family_name, count(*) AS n,
       sum(co2_emissions_g_km) / count(*) AS average_co2_g_km FROM ratings GROUP BY ALL""",
    BASE,
)
def lookup_join(spark, folder):
    coded = R.ratings(spark, folder).drop("fuel_type", "transmission_family")
    named = decode_join(coded, fuel_type_lookup(spark), "fuel_type_code")
    named = decode_join(named, transmission_family_lookup(spark), "transmission_family_code")
    return named.groupBy("fuel_type_name", "transmission_family_name").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("co2_emissions_g_km").cast("decimal(18,0)")).alias("average_co2_g_km")
    )


# --- text and categories -----------------------------------------------------------------------------


# upper-casing turns a sharp s into two letters, which DuckDB's upper() does not do
@query(
    "normalize_text",
    "doc_id:l normalized:s",
    r"""SELECT doc_id, upper(regexp_replace(regexp_replace(replace(text, 'ß', 'ss'), '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')) AS normalized
        FROM documents""",
)
def normalized(spark, folder):
    return table(spark, folder, "documents").select("doc_id", normalize_text("text").alias("normalized"))


PRIORITIES = {
    "1 URGENT": "URGENT",
    "2 HIGH": "HIGH",
    "3 MEDIUM": "MEDIUM",
    "4 NOT SPECIFIED": "UNSPECIFIED",
    "5 LOW": "LOW",
}


@query(
    "canonical_class",
    "o_orderkey:l priority_key:s priority:s",
    f"""SELECT o_orderkey, trim(regexp_replace(upper(o_orderpriority), '[^A-Z0-9]+', ' ', 'g')) AS priority_key,
        CASE trim(regexp_replace(upper(o_orderpriority), '[^A-Z0-9]+', ' ', 'g'))
        {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in PRIORITIES.items())} END AS priority FROM orders""",
)
def canonical_class(spark, folder):
    orders = C.canonicalize(table(spark, folder, "orders"), "o_orderpriority", PRIORITIES, "priority", "priority")
    return orders.withColumn("priority_key", category_key("o_orderpriority"))


@query(
    "family_code",
    "s_suppkey:l code:s",
    "SELECT s_suppkey, nullif(regexp_extract(upper(s_name), '^([A-Z]+)', 1), '') AS code FROM supplier",
)
def family_code(spark, folder):
    return table(spark, folder, "supplier").select("s_suppkey", leading_letters(F.upper("s_name")).alias("code"))


@query(
    "gear_parse",
    "p_partkey:l gear_count:l size_number:d lenient:l",
    r"""SELECT p_partkey, coalesce(TRY_CAST(nullif(regexp_extract(p_brand, '(\d+)$', 1), '') AS INTEGER), 0) AS gear_count,
        CAST(p_size AS DOUBLE) AS size_number, TRY_CAST(p_name AS INTEGER) AS lenient FROM part""",
)
def gear_parse(spark, folder):
    part = table(spark, folder, "part").select(
        "p_partkey",
        trailing_number("p_brand").alias("gear_count"),
        F.col("p_size").cast("string").alias("size_number"),
        F.col("p_name").alias("lenient"),
    )
    return to_numeric(to_numeric(part, {"size_number": "double"}), {"lenient": "int"}, errors="coerce")


# --- duplicates and the cleaning job -----------------------------------------------------------------


@query(
    "exact_dedup",
    "doc_id:l lang:s source:s n_chars:l",
    """SELECT doc_id, lang, source, n_chars FROM documents
       QUALIFY row_number() OVER (PARTITION BY text, lang, source ORDER BY doc_id) = 1""",
)
def exact_dedup(spark, folder):
    kept, _ = C.split_exact_duplicates(table(spark, folder, "documents"), ["text", "lang", "source"], "doc_id")
    return kept


@query(
    "removed_duplicates",
    "doc_id:l lang:s source:s n_chars:l",
    """SELECT doc_id, lang, source, n_chars FROM documents
       QUALIFY row_number() OVER (PARTITION BY text, lang, source ORDER BY doc_id) > 1""",
)
def removed_duplicates(spark, folder):
    _, removed = C.split_exact_duplicates(table(spark, folder, "documents"), ["text", "lang", "source"], "doc_id")
    return removed


@query(
    "cleaning_log",
    "step:s rows_before:l rows_after:l rows_removed:l reason:s",
    """SELECT 'source ingestion' AS step, n AS rows_before, n AS rows_after, 0 AS rows_removed,
              'Read supplied CSV without modifying it' AS reason FROM counted
       UNION ALL SELECT 'exact duplicate removal', n, k, n - k, 'Remove only fully identical records' FROM counted
       UNION ALL SELECT 'canonicalization and feature engineering', k, k, 0,
              'Standardize names and create auditable peer benchmarks' FROM counted""",
    (
        "counted AS (SELECT count(*) AS n, (SELECT count(*) FROM (SELECT DISTINCT text, lang, source FROM documents))"
        " AS k FROM documents)",
    ),
)
def cleaning_log(spark, folder):
    return C.cleaning_log(table(spark, folder, "documents"), ["text", "lang", "source"], "doc_id")


CLEAN_SHAPE = (
    "vehicle_id:l source_row_number:l model_year:l make:s model:s vehicle_class:s engine_size_l:d cylinders:l "
    "transmission_family_code:s transmission_family:s gear_count:l fuel_type_code:s fuel_type:s "
    "fuel_cons_city_l_100km:d fuel_cons_hwy_l_100km:d fuel_cons_comb_l_100km:d fuel_economy_comb_mpg:l "
    "co2_emissions_g_km:l co2_rating:l smog_rating:l city_hwy_gap_l_100km:d3 city_hwy_ratio:d co2_per_comb_l:d "
    "engine_size_band:s class_year_co2_median:d3 class_year_co2_p25:d3 co2_vs_class_year_median:d3 "
    "co2_gap_to_class_p25:d3 above_class_year_median:l city_below_highway_flag:l emission_band:s model_split:s"
)

# rows equal in every raw column are one rating; raw spelling varies by line status, so it is part of the key
DEDUPLICATED = f"""deduplicated AS (
  SELECT * EXCLUDE (spelling, source_row), row_number() OVER (ORDER BY source_row) AS vehicle_id,
         source_row + 1 AS source_row_number
  FROM (SELECT r.*, n.l_linestatus AS spelling,
               row_number() OVER (ORDER BY {', '.join('r.' + t for t in TIE)}) AS source_row
        FROM ratings AS r JOIN lineitem AS n USING ({', '.join(TIE)}))
  QUALIFY row_number() OVER (
    PARTITION BY model_year, make, model, vehicle_class, spelling, engine_size_l, cylinders,
      transmission_family_code, gear_count, fuel_type_code, fuel_cons_city_l_100km, fuel_cons_hwy_l_100km,
      co2_emissions_g_km, co2_rating, smog_rating ORDER BY source_row) = 1)"""

# the window for vehicle_id must see only the rows that stay
KEYED = """keyed AS (SELECT * EXCLUDE (vehicle_id), row_number() OVER (ORDER BY source_row_number) AS vehicle_id
  FROM deduplicated)"""
CLEAN_PEERS = PEER_SQL.replace("peers AS", "clean_peers AS").replace("FROM ratings", "FROM keyed")
CLEAN_FACT = FACT.replace("fact AS", "clean_fact AS").replace("FROM numbered AS r JOIN peers", "FROM keyed AS r JOIN clean_peers")


@query(
    "clean_ratings",
    CLEAN_SHAPE,
    """SELECT *, floor(2824.8 / CAST(fuel_cons_comb_l_100km AS DOUBLE)) AS fuel_economy_comb_mpg,
       fuel_cons_city_l_100km - fuel_cons_hwy_l_100km AS city_hwy_gap_l_100km,
       round_even(CAST(fuel_cons_city_l_100km AS DOUBLE) / CAST(fuel_cons_hwy_l_100km AS DOUBLE), 6) AS city_hwy_ratio,
       round_even(co2_emissions_g_km / CAST(fuel_cons_comb_l_100km AS DOUBLE), 6) AS co2_per_comb_l,
       CASE WHEN fuel_cons_city_l_100km < fuel_cons_hwy_l_100km THEN 1 ELSE 0 END AS city_below_highway_flag
       FROM clean_fact""",
    (*BASE, DEDUPLICATED, KEYED, CLEAN_PEERS, CLEAN_FACT),
)
def clean_ratings(spark, folder):
    return clean_job(spark, folder)


def clean_job(spark, folder):
    raw = R.numbered_raw(spark, folder, "source_row_number", start=2).drop(*TIE)
    return C.clean_ratings(raw, "source_row_number", R.TRAIN_UNTIL, R.VALIDATE_UNTIL)


# --- data quality ------------------------------------------------------------------------------------


@query(
    "dq_checks",
    "clean_rows:l unique_vehicle_ids:l missing_required_values:l invalid_model_year:l invalid_engine_size:l "
    "invalid_cylinders:l invalid_consumption:l invalid_co2:l invalid_co2_rating:l invalid_smog_rating:l "
    "unmapped_fuel_codes:l unmapped_transmission_codes:l combined_outside_city_highway_range:l "
    "city_below_highway_rows:l",
    f"""SELECT count(*) AS clean_rows, count(DISTINCT vehicle_id) AS unique_vehicle_ids,
        {' + '.join(f'count_if({c} IS NULL)' for c in S.REQUIRED_COLUMNS)} AS missing_required_values,
        count_if(model_year NOT BETWEEN 1996 AND 2000) AS invalid_model_year,
        count_if(engine_size_l <= 0) AS invalid_engine_size, count_if(cylinders <= 0) AS invalid_cylinders,
        count_if(least(fuel_cons_city_l_100km, fuel_cons_hwy_l_100km, fuel_cons_comb_l_100km) <= 0) AS invalid_consumption,
        count_if(co2_emissions_g_km <= 0) AS invalid_co2,
        count_if(co2_rating NOT BETWEEN 1 AND 10) AS invalid_co2_rating,
        count_if(smog_rating NOT BETWEEN 1 AND 10) AS invalid_smog_rating,
        count_if(fuel_type IS NULL) AS unmapped_fuel_codes,
        count_if(transmission_family IS NULL) AS unmapped_transmission_codes,
        count_if(fuel_cons_comb_l_100km < least(fuel_cons_city_l_100km, fuel_cons_hwy_l_100km) - 0.11
              OR fuel_cons_comb_l_100km > greatest(fuel_cons_city_l_100km, fuel_cons_hwy_l_100km) + 0.11)
          AS combined_outside_city_highway_range,
        count_if(fuel_cons_city_l_100km < fuel_cons_hwy_l_100km) AS city_below_highway_rows FROM numbered""",
    (*BASE, NUMBERED),
)
def dq_checks(spark, folder):
    # the narrower year range leaves rows for the rule to count
    return Q.dq_checks(R.numbered_ratings(spark, folder), first_year=1996, last_year=2000)


@query(
    "dq_checkpoint",
    "row_count:l unique_vehicle_ids:l first_model_year:l latest_model_year:l missing_target_rows:l "
    "invalid_fuel_code_rows:l",
    """SELECT count(*) AS row_count, count(DISTINCT l_orderkey) AS unique_vehicle_ids, min(model_year) AS first_model_year,
       max(model_year) AS latest_model_year, count_if(co2_emissions_g_km IS NULL) AS missing_target_rows,
       count_if(fuel_type_code NOT IN ('X', 'Z')) AS invalid_fuel_code_rows FROM ratings""",
    BASE,
)
def dq_checkpoint(spark, folder):
    return Q.dq_checkpoint(R.ratings(spark, folder), ["X", "Z"], "l_orderkey")


PROFILED = [
    "engine_size_l",
    "cylinders",
    "fuel_cons_city_l_100km",
    "fuel_cons_hwy_l_100km",
    "fuel_cons_comb_l_100km",
    "co2_emissions_g_km",
    "co2_rating",
    "smog_rating",
]


@query(
    "numeric_profile",
    "column_name:s value_count:l min_value:d max_value:d mean_value:d median_value:d",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count({c}) AS value_count, CAST(min({c}) AS DOUBLE) AS min_value,
            CAST(max({c}) AS DOUBLE) AS max_value, CAST(sum({c}) AS DOUBLE) / count({c}) AS mean_value,
            quantile_cont(CAST({c} AS DOUBLE), 0.5) AS median_value FROM ratings"""
        for c in PROFILED
    ),
    BASE,
)
def numeric_profile(spark, folder):
    return Q.numeric_profile(R.ratings(spark, folder), PROFILED)


SPREAD = ["engine_size_l", "cylinders", "fuel_cons_comb_l_100km", "co2_emissions_g_km", "co2_per_comb_l"]


@query(
    "iqr_outliers",
    "column_name:s lower_bound:d upper_bound:d outlier_rows:l",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, lo AS lower_bound, hi AS upper_bound, count_if(v < lo OR v > hi) AS outlier_rows
            FROM (SELECT CAST({c} AS DOUBLE) AS v FROM ratios),
                 (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) - 1.5 * (quantile_cont(CAST({c} AS DOUBLE), 0.75)
                           - quantile_cont(CAST({c} AS DOUBLE), 0.25)) AS lo,
                         quantile_cont(CAST({c} AS DOUBLE), 0.75) + 1.5 * (quantile_cont(CAST({c} AS DOUBLE), 0.75)
                           - quantile_cont(CAST({c} AS DOUBLE), 0.25)) AS hi FROM ratios)
            GROUP BY lo, hi"""
        for c in SPREAD
    ),
    (
        *BASE,
        "ratios AS (SELECT *, round_even(co2_emissions_g_km / CAST(fuel_cons_comb_l_100km AS DOUBLE), 6) AS co2_per_comb_l FROM ratings)",
    ),
)
def iqr_outliers(spark, folder):
    return Q.iqr_outliers(R.ratings(spark, folder), SPREAD)


@query(
    "missing_counts",
    "column_name:s missing_values:l",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count_if({c} IS NULL) AS missing_values FROM ratings"
        for c in ["model_year", "make", "co2_emissions_g_km", "co2_rating", "smog_rating"]
    ),
    BASE,
)
def missing_counts(spark, folder):
    names = ["model_year", "make", "co2_emissions_g_km", "co2_rating", "smog_rating"]
    return Q.missing_counts(R.ratings(spark, folder), names)


@query(
    "cardinalities",
    "column_name:s distinct_values:l",
    """SELECT 'raw_make' AS column_name, count(DISTINCT CASE l_linestatus WHEN 'F' THEN ' ' || p_brand ELSE upper(p_brand) END)
         AS distinct_values FROM lineitem JOIN part ON l_partkey = p_partkey
       UNION ALL SELECT 'canonical_make', count(DISTINCT upper(p_brand)) FROM lineitem JOIN part ON l_partkey = p_partkey
       UNION ALL SELECT 'model', count(DISTINCT upper(p_name)) FROM lineitem JOIN part ON l_partkey = p_partkey
       UNION ALL SELECT 'raw_vehicle_class', count(DISTINCT p_type || l_linestatus) FROM lineitem JOIN part ON l_partkey = p_partkey
       UNION ALL SELECT 'canonical_vehicle_class', count(DISTINCT p_type) FROM lineitem JOIN part ON l_partkey = p_partkey
       UNION ALL SELECT 'fuel_type', count(DISTINCT l_returnflag) FROM lineitem JOIN part ON l_partkey = p_partkey""",
)
def cardinalities(spark, folder):
    raw = R.raw_ratings(spark, folder)
    canonical = C.canonical_columns(raw.withColumnsRenamed(S.COLUMN_MAP))
    both = canonical.select("make", "model", "vehicle_class", "fuel_type_code")
    raw_side = Q.cardinalities(raw, {"raw_make": "Make", "raw_vehicle_class": "VehicleClass"})
    clean_side = Q.cardinalities(
        both,
        {
            "canonical_make": "make",
            "model": "model",
            "canonical_vehicle_class": "vehicle_class",
            "fuel_type": "fuel_type_code",
        },
    )
    return raw_side.unionByName(clean_side)


@query(
    "rating_availability",
    "co2_rating_nonmissing:l co2_rating_first_year:l smog_rating_nonmissing:l smog_rating_first_year:l",
    """SELECT count(co2_rating) AS co2_rating_nonmissing, min(model_year) FILTER (co2_rating IS NOT NULL) AS co2_rating_first_year,
       count(smog_rating) AS smog_rating_nonmissing, min(model_year) FILTER (smog_rating IS NOT NULL) AS smog_rating_first_year
       FROM ratings""",
    BASE,
)
def rating_availability(spark, folder):
    return Q.availability(R.ratings(spark, folder), ["co2_rating", "smog_rating"])


@query(
    "leakage_corr",
    "correlation:d",
    "SELECT corr(CAST(co2_emissions_g_km AS DOUBLE), CAST(fuel_cons_comb_l_100km AS DOUBLE)) AS correlation FROM ratings",
    BASE,
)
def leakage_corr(spark, folder):
    return Q.correlation(R.ratings(spark, folder), "co2_emissions_g_km", "fuel_cons_comb_l_100km")


@query(
    "group_ols",
    "fuel_type_code:s rows:l slope:d intercept:d r_squared:d",
    """SELECT fuel_type_code, count(*) AS rows, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept,
       regr_r2(y, x) AS r_squared
       FROM (SELECT fuel_type_code, CAST(co2_emissions_g_km AS DOUBLE) AS y, CAST(fuel_cons_comb_l_100km AS DOUBLE) AS x
             FROM ratings) GROUP BY fuel_type_code""",
    BASE,
)
def group_ols(spark, folder):
    return Q.group_ols(R.ratings(spark, folder), "fuel_type_code", "fuel_cons_comb_l_100km", "co2_emissions_g_km")


@query(
    "share_within",
    "share_within:d",
    """SELECT count_if(abs(fuel_cons_comb_l_100km - (CAST(0.55 AS DECIMAL(3,2)) * fuel_cons_city_l_100km
       + CAST(0.45 AS DECIMAL(3,2)) * fuel_cons_hwy_l_100km)) <= 0.03) / count(*) AS share_within FROM ratings""",
    BASE,
)
def share_within(spark, folder):
    # rounding to one digit moves a blend by up to 0.05, so a tolerance of 0.03 splits the rows
    return Q.share_within(
        R.ratings(spark, folder),
        "fuel_cons_comb_l_100km",
        "fuel_cons_city_l_100km",
        "fuel_cons_hwy_l_100km",
        tolerance=0.03,
    )


FKS = [
    ("lineitem", "orders", "l_orderkey", "o_orderkey"),
    ("lineitem", "part", "l_partkey", "p_partkey"),
    ("lineitem", "supplier", "l_suppkey", "s_suppkey"),
    ("orders", "customer", "o_custkey", "c_custkey"),
    ("customer", "orders", "c_custkey", "o_custkey"),
    ("documents", "labels", "doc_id", "doc_id"),
]


@query(
    "fk_violations",
    "constraint_name:s orphan_keys:l orphan_rows:l",
    " UNION ALL ".join(
        f"""SELECT '{c}.{ck} to {p}.{pk}' AS constraint_name, count(DISTINCT c.{ck}) AS orphan_keys, count(*) AS orphan_rows
            FROM {c} AS c WHERE c.{ck} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {p} AS p WHERE p.{pk} = c.{ck})"""
        for c, p, ck, pk in FKS
    ),
)
def fks(spark, folder):
    found = [
        fk_violations(table(spark, folder, c), table(spark, folder, p), ck, pk, f"{c}.{ck} to {p}.{pk}")
        for c, p, ck, pk in FKS
    ]
    return stack(*found)


PKS = [
    ("orders", ["o_orderkey"]),
    ("part", ["p_partkey"]),
    ("lineitem", ["l_orderkey", "l_linenumber"]),
    ("conversations", ["conv_id", "turn"]),
    ("conversations", ["conv_id"]),
]


@query(
    "pk_violations",
    "constraint_name:s repeated_keys:l repeated_rows:l",
    " UNION ALL ".join(
        f"""SELECT '{t}({",".join(k)})' AS constraint_name, count(*) AS repeated_keys, coalesce(sum(n), 0) AS repeated_rows
            FROM (SELECT count(*) AS n FROM {t} GROUP BY {", ".join(k)} HAVING count(*) > 1)"""
        for t, k in PKS
    ),
)
def pks(spark, folder):
    return stack(*[pk_violations(table(spark, folder, t), k, f"{t}({','.join(k)})") for t, k in PKS])


@query(
    "constraint_counts",
    "constraint_name:s violations:l",
    """SELECT * FROM (SELECT count_if(model_year NOT BETWEEN 1996 AND 2000) AS chk_vehicle_year,
         count_if(engine_size_l <= 0) AS chk_engine_size, count_if(cylinders <= 0) AS chk_cylinders,
         count_if(fuel_cons_city_l_100km <= 0 OR fuel_cons_hwy_l_100km <= 0 OR fuel_cons_comb_l_100km <= 0) AS chk_consumption,
         count_if(co2_emissions_g_km <= 0) AS chk_co2, count_if(co2_rating NOT BETWEEN 1 AND 10) AS chk_co2_rating,
         count_if(smog_rating NOT BETWEEN 1 AND 10) AS chk_smog_rating,
         count_if(model_split NOT IN ('train', 'validation', 'test')) AS enum_model_split FROM ratings)
       UNPIVOT (violations FOR constraint_name IN (chk_vehicle_year, chk_engine_size, chk_cylinders, chk_consumption,
         chk_co2, chk_co2_rating, chk_smog_rating, enum_model_split))""",
    BASE,
)
def constraint_counts(spark, folder):
    return Q.constraint_counts(R.ratings(spark, folder), 1996, 2000)


@query(
    "load_check",
    "loaded_rows:l unique_keys:l invalid_rows:l",
    """SELECT count(*) AS loaded_rows, count(DISTINCT vehicle_id) AS unique_keys,
       count_if(co2_emissions_g_km <= 0 OR engine_size_l <= 0 OR cylinders <= 0) AS invalid_rows FROM fact""",
    PEERED,
)
def loaded(spark, folder):
    rows = R.numbered_fact(spark, folder).withColumn("source_row_number", F.col("vehicle_id") + 1)
    invalid = (F.col("co2_emissions_g_km") <= 0) | (F.col("engine_size_l") <= 0) | (F.col("cylinders") <= 0)
    path = scratch_path(spark, "load-check")
    return load_check(load_table(rows, path, S.FACT_COLUMNS, "vehicle_id", invalid), "vehicle_id", invalid)


@query("audit_report", "source_rows:l source_columns:l report:s")
def audit_report(spark, folder):
    raw = R.raw_ratings(spark, folder)
    report = Q.audit_report(raw, clean_job(spark, folder))
    return report.withColumn("report", F.to_json(F.struct(*report.columns)))
