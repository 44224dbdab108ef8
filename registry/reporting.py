"""Trend, benchmark, ranking, share and opportunity queries."""

from __future__ import annotations

from ratingloom.functions.numeric import bucketize
from ratingloom.operators import benchmarks as B, scenario as X
from ratingloom.operators.ordering import sample_cap
from ratingloom.sources import schema as S
from registry import tables as R
from registry.catalog import query
from registry.tables import BASE, PEERED, SINCE, TIE

TIE_ORDER = ", ".join(TIE)

MEANS = """count(*) AS vehicle_records,
    round(sum(co2_emissions_g_km) / count(*), 4) AS average_co2_g_km,
    round(CAST(sum(fuel_cons_comb_l_100km) AS DOUBLE) / count(*), 5) AS average_combined_l_100km,
    round(CAST(sum(engine_size_l) AS DOUBLE) / count(*), 5) AS average_engine_size_l,
    round(CAST(sum(co2_gap_to_class_p25) AS DOUBLE) / count(*), 7) AS average_peer_gap_g_km"""
PLAIN = """count(*) AS vehicle_records,
    sum(co2_emissions_g_km) / count(*) AS average_co2_g_km,
    CAST(sum(fuel_cons_comb_l_100km) AS DOUBLE) / count(*) AS average_combined_l_100km,
    CAST(sum(engine_size_l) AS DOUBLE) / count(*) AS average_engine_size_l"""
PLAIN_GAP = PLAIN + ", CAST(sum(co2_gap_to_class_p25) AS DOUBLE) / count(*) AS average_peer_gap_g_km"
MEANS_SHAPE = (
    "vehicle_records:l average_co2_g_km:d4 average_combined_l_100km:d5 average_engine_size_l:d5 "
    "average_peer_gap_g_km:d7"
)
YEARLY = f"yearly AS (SELECT model_year, {MEANS} FROM fact GROUP BY model_year)"

# --- trends ------------------------------------------------------------------------------------------


@query(
    "yearly_trend",
    f"model_year:l {MEANS_SHAPE} previous_year_average_co2:d4 co2_yoy_change_pct:d8 co2_change_vs_1995_pct:d8",
    """SELECT y.*, p.average_co2_g_km AS previous_year_average_co2,
       y.average_co2_g_km / p.average_co2_g_km - 1 AS co2_yoy_change_pct,
       y.average_co2_g_km / b.average_co2_g_km - 1 AS co2_change_vs_1995_pct
       FROM yearly AS y JOIN yearly AS b ON b.model_year = 1995
       LEFT JOIN yearly AS p ON p.model_year = (SELECT max(model_year) FROM yearly AS e WHERE e.model_year < y.model_year)""",
    (*PEERED, YEARLY),
)
def yearly_trend(spark, folder):
    return B.yearly_trend(R.fact(spark, folder))


@query(
    "yoy_query",
    "model_year:l vehicle_records:l average_co2_g_km:d4 average_combined_l_100km:d5 previous_year_co2:d4 "
    "co2_yoy_change_pct:d8",
    """SELECT *, average_co2_g_km / previous_year_co2 - 1 AS co2_yoy_change_pct FROM (
         SELECT model_year, vehicle_records, average_co2_g_km, average_combined_l_100km,
                lag(average_co2_g_km) OVER (ORDER BY model_year) AS previous_year_co2 FROM yearly)""",
    (*PEERED, YEARLY),
)
def yoy_query(spark, folder):
    return B.yoy_movement(R.ratings(spark, folder))


@query(
    "rolling3",
    "model_year:l average_co2_g_km:d4 rolling_three_year_average_co2:d",
    """SELECT model_year, average_co2_g_km, avg(average_co2_g_km) OVER (
         ORDER BY model_year ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS rolling_three_year_average_co2 FROM yearly""",
    (*PEERED, YEARLY),
)
def rolling3(spark, folder):
    return B.rolling_trend(R.ratings(spark, folder))


@query(
    "yearly_summary",
    "model_year:l vehicle_records:l average_co2_g_km:d median_co2_g_km:d average_combined_l_100km:d "
    "average_engine_size_l:d average_peer_gap_g_km:d co2_yoy_change_pct:d8 co2_change_vs_1995_pct:d8",
    """SELECT *, average_co2_g_km / lag(average_co2_g_km) OVER (ORDER BY model_year) - 1 AS co2_yoy_change_pct,
       average_co2_g_km / (SELECT average_co2_g_km FROM plain WHERE model_year = 1995) - 1 AS co2_change_vs_1995_pct
       FROM plain""",
    (
        *PEERED,
        f"""plain AS (SELECT model_year, {PLAIN_GAP}, quantile_cont(CAST(co2_emissions_g_km AS DOUBLE), 0.5) AS median_co2_g_km
            FROM fact GROUP BY model_year)""",
    ),
)
def yearly_summary(spark, folder):
    return B.yearly_summary(R.fact(spark, folder))


# --- peer benchmarks and group summaries -------------------------------------------------------------


@query(
    "peer_benchmark",
    "l_orderkey:l l_linenumber:l l_partkey:l l_suppkey:l l_quantity:d l_extendedprice:d model_year:l vehicle_class:s "
    "class_year_co2_median:d3 class_year_co2_p25:d3 co2_vs_class_year_median:d3 co2_gap_to_class_p25:d3 "
    "above_class_year_median:l",
    "SELECT * FROM fact",
    PEERED,
)
def peer_benchmark(spark, folder):
    return R.fact(spark, folder)


CLASS_YEAR = "model_year:l vehicle_class:s"


@query(
    "class_year_stats",
    f"{CLASS_YEAR} vehicle_records:l average_co2_g_km:d median_co2_g_km:d p25_co2_g_km:d average_combined_l_100km:d "
    "average_engine_size_l:d average_peer_gap_g_km:d",
    f"""SELECT model_year, vehicle_class, {PLAIN_GAP}, quantile_cont(CAST(co2_emissions_g_km AS DOUBLE), 0.5) AS median_co2_g_km,
        quantile_cont(CAST(co2_emissions_g_km AS DOUBLE), 0.25) AS p25_co2_g_km FROM fact GROUP BY model_year, vehicle_class""",
    PEERED,
)
def class_year_stats(spark, folder):
    return B.class_year_stats(R.fact(spark, folder))


@query(
    "class_benchmark",
    f"{CLASS_YEAR} {MEANS_SHAPE} median_co2_g_km:d7 p25_co2_g_km:d7 high_to_low_emission_rank:l",
    f"""SELECT *, rank() OVER (PARTITION BY model_year ORDER BY average_co2_g_km DESC) AS high_to_low_emission_rank FROM (
          SELECT model_year, vehicle_class, {MEANS}, avg(class_year_co2_median) AS median_co2_g_km,
                 avg(class_year_co2_p25) AS p25_co2_g_km FROM fact GROUP BY model_year, vehicle_class)""",
    PEERED,
)
def class_benchmark(spark, folder):
    return B.class_benchmark(R.fact(spark, folder))


@query(
    "make_benchmark",
    f"model_year:l make:s {MEANS_SHAPE} low_to_high_emission_rank:l",
    f"""SELECT *, rank() OVER (PARTITION BY model_year ORDER BY average_co2_g_km) AS low_to_high_emission_rank FROM (
          SELECT model_year, make, {MEANS} FROM fact GROUP BY model_year, make)""",
    PEERED,
)
def make_benchmark(spark, folder):
    return B.make_benchmark(R.fact(spark, folder))


@query(
    "make_year_summary",
    "model_year:l make:s vehicle_records:l average_co2_g_km:d average_combined_l_100km:d average_engine_size_l:d "
    "average_peer_gap_g_km:d",
    f"SELECT model_year, make, {PLAIN_GAP} FROM fact GROUP BY model_year, make",
    PEERED,
)
def make_year_summary(spark, folder):
    return B.make_year_summary(R.fact(spark, folder))


PLAIN_SHAPE = "vehicle_records:l average_co2_g_km:d average_combined_l_100km:d average_engine_size_l:d"
for _name, _spec in (
    ("fuel_year", "fuel_type_year_summary"),
    ("band_year", "engine_band_year_summary"),
    ("transmission_year", "transmission_year_summary"),
):
    _keys = B.SUMMARY_KEYS[_spec]

    def _summary(spark, folder, spec=_spec):
        return B.group_summaries(R.ratings(spark, folder), {spec: B.SUMMARY_KEYS[spec]})[spec]

    query(
        _name,
        " ".join(f"{key}:{'l' if key == 'model_year' else 's'}" for key in _keys) + " " + PLAIN_SHAPE,
        f"SELECT {', '.join(_keys)}, {PLAIN} FROM ratings GROUP BY {', '.join(_keys)}",
        BASE,
    )(_summary)


# --- rankings and shares -----------------------------------------------------------------------------


@query(
    "latest_class_rank",
    "vehicle_class:s vehicle_records:l average_co2_g_km:d4 average_combined_l_100km:d5 high_emission_rank:l",
    f"""SELECT *, rank() OVER (ORDER BY average_co2_g_km DESC) AS high_emission_rank FROM (
          SELECT vehicle_class, {MEANS} FROM fact WHERE model_year = (SELECT max(model_year) FROM fact) GROUP BY vehicle_class)""",
    PEERED,
)
def latest_class_rank(spark, folder):
    return B.latest_class_rank(R.ratings(spark, folder))


@query(
    "latest_make_rank",
    "make:s vehicle_records:l average_co2_g_km:d4 average_engine_size_l:d5 low_emission_rank:l",
    f"""SELECT *, rank() OVER (ORDER BY average_co2_g_km) AS low_emission_rank FROM (
          SELECT make, {MEANS} FROM fact WHERE model_year = (SELECT max(model_year) FROM fact) GROUP BY make)
        WHERE vehicle_records >= 300""",
    PEERED,
)
def latest_make_rank(spark, folder):
    # makes hold a few hundred rows of the latest year here, so this minimum splits them
    return B.latest_make_rank(R.ratings(spark, folder), min_records=300)


@query(
    "engine_band_case",
    "engine_size_band:s vehicle_records:l average_co2_g_km:d4 average_combined_l_100km:d5",
    f"SELECT engine_size_band, {MEANS} FROM fact GROUP BY engine_size_band",
    PEERED,
)
def engine_band_case(spark, folder):
    band = bucketize("engine_size_l", S.ENGINE_EDGES, S.ENGINE_LABELS, null_label=S.ENGINE_LABELS[-1])
    return B.engine_band_case(R.ratings(spark, folder), band)


@query(
    "fuel_mix_share",
    "model_year:l fuel_type_name:s vehicle_records:l average_co2_g_km:d4 record_share:d4",
    """SELECT model_year, fuel_type_name, vehicle_records, average_co2_g_km,
       round(vehicle_records / sum(vehicle_records) OVER (PARTITION BY model_year), 4) AS record_share FROM (
         SELECT model_year, fuel_type AS fuel_type_name, count(*) AS vehicle_records,
                sum(co2_emissions_g_km) / count(*) AS average_co2_g_km FROM ratings GROUP BY ALL)""",
    BASE,
)
def fuel_mix_share(spark, folder):
    return B.fuel_mix_share(R.ratings(spark, folder), "fuel_type").withColumnRenamed("fuel_type", "fuel_type_name")


# --- opportunities -----------------------------------------------------------------------------------

OPPORTUNITY = (
    "model_year:l vehicle_class:s make:s model:s co2_emissions_g_km:l class_year_co2_p25:d3 co2_gap_to_class_p25:d3 "
    "l_orderkey:l l_linenumber:l l_partkey:l"
)
RANKED = f"""ranked AS (SELECT *, rank() OVER (PARTITION BY model_year, vehicle_class
    ORDER BY co2_gap_to_class_p25 DESC, co2_emissions_g_km DESC) AS within_class_opportunity_rank
  FROM fact WHERE model_year >= {SINCE} AND co2_gap_to_class_p25 > 0)"""


@query(
    "opportunities",
    f"{OPPORTUNITY} within_class_opportunity_rank:l",
    "SELECT * FROM ranked",
    (*PEERED, RANKED),
)
def opportunities(spark, folder):
    return X.ranked_opportunities(R.fact(spark, folder), SINCE)


@query(
    "top_opportunities",
    OPPORTUNITY,
    f"""SELECT * FROM fact WHERE model_year >= {SINCE}
        ORDER BY co2_gap_to_class_p25 DESC, co2_emissions_g_km DESC, {TIE_ORDER} LIMIT 500""",
    PEERED,
)
def top_opportunities(spark, folder):
    return X.top_opportunities(R.fact(spark, folder), SINCE, tie=TIE)


@query(
    "export_opportunities",
    f"{OPPORTUNITY} within_class_opportunity_rank:l",
    f"SELECT * FROM ranked ORDER BY co2_gap_to_class_p25 DESC, {TIE_ORDER} LIMIT 500",
    (*PEERED, RANKED),
)
def export_opportunities(spark, folder):
    return X.export_opportunities(X.ranked_opportunities(R.fact(spark, folder), SINCE), tie=TIE)


@query(
    "opportunity_quartile",
    "vehicle_id:l model_year:l vehicle_class:s make:s model:s co2_emissions_g_km:l class_year_co2_p25:d3 "
    "co2_gap_to_class_p25:d3 opportunity_quartile:l",
    f"""SELECT * FROM (SELECT *, ntile(4) OVER (PARTITION BY model_year, vehicle_class
          ORDER BY co2_gap_to_class_p25 DESC, vehicle_id) AS opportunity_quartile FROM fact WHERE model_year >= {SINCE})
        WHERE opportunity_quartile = 1""",
    PEERED,
)
def opportunity_quartile(spark, folder):
    return X.opportunity_quartile(R.numbered_fact(spark, folder), SINCE)


@query(
    "sample_cap",
    "l_orderkey:l l_linenumber:l l_partkey:l l_suppkey:l vehicle_class:s co2_emissions_g_km:l",
    f"""SELECT * FROM ratings WHERE model_split = 'test'
        ORDER BY md5(concat_ws('|', '42', l_orderkey, l_linenumber, l_partkey, l_suppkey)),
          l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 3500""",
    BASE,
)
def sampled(spark, folder):
    rows = R.ratings(spark, folder).where("model_split = 'test'")
    return sample_cap(rows, 3_500, 42, TIE[:4])
