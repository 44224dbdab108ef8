"""Cube, filter, mix, distribution and scenario queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratingloom.operators import cube as K, scenario as X
from ratingloom.operators.joins import latest_only
from ratingloom.operators.ordering import top_n_displayed
from ratingloom.plans import pages as P
from registry import tables as R
from registry.catalog import query
from registry.reporting import MEANS, MEANS_SHAPE
from registry.tables import PEERED, RATINGS, SINCE, TIE

CUBE_KEYS = "model_year, vehicle_class, make, model, fuel_type"
CUBE_SHAPE = "model_year:l vehicle_class:s make:s model:s fuel_type:s"
CUBE = (*PEERED, f"cube AS (SELECT {CUBE_KEYS}, {MEANS} FROM fact GROUP BY {CUBE_KEYS})")
BANDS = (
    *PEERED,
    f"bands AS (SELECT {CUBE_KEYS}, engine_size_band, {MEANS} FROM fact GROUP BY {CUBE_KEYS}, engine_size_band)",
)
CHOICE = P.Filters((1997, 2000), ["COMPACT", "SUV - SMALL", "TWO-SEATER"], ["Diesel", "Premium Gasoline"], [], "")
CHOSEN = """model_year BETWEEN 1997 AND 2000 AND vehicle_class IN ('COMPACT', 'SUV - SMALL', 'TWO-SEATER')
    AND fuel_type IN ('Diesel', 'Premium Gasoline')"""


def weighted(name: str) -> str:
    return f"CAST(sum({name} * vehicle_records) AS DOUBLE) / sum(vehicle_records) AS {name}"


def segments(spark, folder):
    return K.segment_summary(R.fact(spark, folder))


def bands(spark, folder):
    return K.engine_band_summary(R.ratings(spark, folder))


@query("segment_summary", f"{CUBE_SHAPE} {MEANS_SHAPE}", "SELECT * FROM cube", CUBE)
def segment_summary(spark, folder):
    return segments(spark, folder)


@query(
    "engine_band_summary",
    f"{CUBE_SHAPE} engine_size_band:s vehicle_records:l average_combined_l_100km:d5 average_co2_g_km:d4",
    "SELECT * FROM bands",
    BANDS,
)
def engine_band_summary(spark, folder):
    return bands(spark, folder)


@query("segment_filter", f"{CUBE_SHAPE} {MEANS_SHAPE}", f"SELECT * FROM cube WHERE {CHOSEN}", CUBE)
def segment_filter(spark, folder):
    return CHOICE.apply(segments(spark, folder))


@query(
    "text_search",
    f"{CUBE_SHAPE} {MEANS_SHAPE}",
    "SELECT * FROM cube WHERE contains(lower(make), 'd#1') OR contains(lower(model), 'd#1')",
    CUBE,
)
def text_search(spark, folder):
    return K.search(segments(spark, folder), "D#1")


@query(
    "weighted_average",
    "average_co2_g_km:d",
    "SELECT sum(average_co2_g_km * vehicle_records) / sum(vehicle_records) AS average_co2_g_km FROM cube",
    CUBE,
)
def weighted_average(spark, folder):
    return K.weighted_average(segments(spark, folder), "average_co2_g_km")


@query(
    "reaggregate_weighted",
    "make:s vehicle_records:l average_co2_g_km:d average_combined_l_100km:d average_peer_gap_g_km:d",
    f"""SELECT make, sum(vehicle_records) AS vehicle_records,
        {", ".join(weighted(v) for v in P.MAKE_VALUES)} FROM cube GROUP BY make""",
    CUBE,
)
def reaggregate_weighted(spark, folder):
    return K.aggregate_weighted(segments(spark, folder), ["make"], P.MAKE_VALUES)


@query(
    "segment_kpis",
    "vehicle_configurations:l average_co2_g_km:d average_combined_l_100km:d average_peer_gap_g_km:d model_years:l",
    f"""SELECT sum(vehicle_records) AS vehicle_configurations,
        {", ".join(weighted(v) for v in P.MAKE_VALUES)}, count(DISTINCT model_year) AS model_years
        FROM cube WHERE {CHOSEN}""",
    CUBE,
)
def segment_kpis(spark, folder):
    return K.segment_kpis(CHOICE.apply(segments(spark, folder)))


@query(
    "overview_trend",
    "model_year:l vehicle_records:l average_co2_g_km:d",
    f"""SELECT model_year, sum(vehicle_records) AS vehicle_records, {weighted("average_co2_g_km")}
        FROM cube WHERE {CHOSEN} GROUP BY model_year""",
    CUBE,
)
def overview_trend(spark, folder):
    return K.aggregate_weighted(CHOICE.apply(segments(spark, folder)), ["model_year"], ["average_co2_g_km"])


MIX = """SELECT {key}, sum({value}) AS {value} FROM (
    SELECT CASE WHEN spot < 6 OR groups <= 6 THEN {key} ELSE 'Other' END AS {key}, {value} FROM (
      SELECT *, row_number() OVER (ORDER BY {value} DESC, {key}) AS spot, count(*) OVER () AS groups
      FROM ({source}))) GROUP BY 1"""


@query(
    "category_mix",
    "make:s vehicle_records:l",
    MIX.format(
        key="make",
        value="vehicle_records",
        source="SELECT make, sum(vehicle_records) AS vehicle_records FROM cube GROUP BY make",
    ),
    CUBE,
)
def category_mix(spark, folder):
    return K.category_mix(segments(spark, folder), "make", "vehicle_records")


@query(
    "class_mix",
    "vehicle_class:s vehicle_records:l",
    "SELECT vehicle_class, sum(vehicle_records) AS vehicle_records FROM cube GROUP BY vehicle_class",
    CUBE,
)
def class_mix(spark, folder):
    # six classes fit the limit of six, so nothing folds
    return K.category_mix(segments(spark, folder), "vehicle_class", "vehicle_records")


@query(
    "top_n_classes",
    "vehicle_class:s vehicle_records:l average_co2_g_km:d",
    f"""SELECT vehicle_class, sum(vehicle_records) AS vehicle_records, {weighted("average_co2_g_km")}
        FROM cube GROUP BY vehicle_class ORDER BY average_co2_g_km DESC, vehicle_class LIMIT 4""",
    CUBE,
)
def top_n_classes(spark, folder):
    return P.top_n_classes(segments(spark, folder), n=4)


ROLLED_MAKES = f"""SELECT make, sum(vehicle_records) AS vehicle_records,
    {", ".join(weighted(v) for v in P.MAKE_VALUES)} FROM cube GROUP BY make"""
MAKE_SHAPE = "make:s vehicle_records:l average_co2_g_km:d average_combined_l_100km:d average_peer_gap_g_km:d"


@query(
    "bottom_n_makes",
    MAKE_SHAPE,
    f"SELECT * FROM ({ROLLED_MAKES}) ORDER BY average_co2_g_km, make LIMIT 10",
    CUBE,
)
def bottom_n_makes(spark, folder):
    rolled = K.aggregate_weighted(segments(spark, folder), ["make"], P.MAKE_VALUES)
    return top_n_displayed(rolled, ["average_co2_g_km", "make"], 10, ["-average_co2_g_km", "make"])


@query(
    "guarded_make_rank",
    MAKE_SHAPE,
    f"""SELECT * FROM ({ROLLED_MAKES}) WHERE vehicle_records >= 2400
        OR (SELECT max(vehicle_records) FROM ({ROLLED_MAKES})) < 2400 ORDER BY average_co2_g_km, make LIMIT 10""",
    CUBE,
)
def guarded_make_rank(spark, folder):
    # a make holds about 2,400 rows here, so this minimum splits them
    return P.guarded_make_rank(segments(spark, folder), minimum=2_400)


@query(
    "guard_fallback",
    MAKE_SHAPE,
    f"SELECT * FROM ({ROLLED_MAKES}) ORDER BY vehicle_records DESC, make LIMIT 40",
    CUBE,
)
def guard_fallback(spark, folder):
    # no make reaches the minimum, so the guard keeps every make
    return P.make_scatter(segments(spark, folder), minimum=1_000_000_000)


@query(
    "class_gaps",
    "vehicle_class:s average_peer_gap_g_km:d",
    f"""SELECT vehicle_class, {weighted("average_peer_gap_g_km")} FROM cube GROUP BY vehicle_class
        ORDER BY average_peer_gap_g_km DESC, vehicle_class LIMIT 10""",
    CUBE,
)
def class_gaps(spark, folder):
    return P.segments_page(segments(spark, folder), P.Filters())["class_gaps"]


@query(
    "engine_band_profile",
    "engine_size_band:s vehicle_records:l average_combined_l_100km:d bubble_size:d",
    f"""SELECT *, 34 + average_combined_l_100km / max(average_combined_l_100km) OVER () * 46 AS bubble_size FROM (
          SELECT engine_size_band, sum(vehicle_records) AS vehicle_records, {weighted("average_combined_l_100km")}
          FROM bands GROUP BY engine_size_band)""",
    BANDS,
)
def engine_band_profile(spark, folder):
    return P.engine_band_profile(bands(spark, folder))


# --- the scenario page over the exported opportunities -----------------------------------------------

EXPORTED = (
    *PEERED,
    f"""exported AS (SELECT * FROM fact WHERE model_year >= {SINCE} AND co2_gap_to_class_p25 > 0
        ORDER BY co2_gap_to_class_p25 DESC, {", ".join(TIE)} LIMIT 500)""",
)
ABOVE = (
    *PEERED,
    f"above AS (SELECT * FROM fact WHERE model_year >= {SINCE} AND co2_gap_to_class_p25 > 0)",
)


def exported(spark, folder):
    return X.export_opportunities(X.opportunities(R.fact(spark, folder), SINCE), tie=TIE)


def above(spark, folder):
    return X.opportunities(R.fact(spark, folder), SINCE)


@query(
    "opportunity_mix",
    "make:s configurations:l",
    MIX.format(
        key="make", value="configurations", source="SELECT make, count(*) AS configurations FROM exported GROUP BY make"
    ),
    EXPORTED,
)
def opportunity_mix(spark, folder):
    return K.opportunity_mix(exported(spark, folder), "make")


@query(
    "gap_histogram",
    "bin:l bin_start:d bin_end:d configurations:l",
    """SELECT bin, lo + (bin - 1) * (hi - lo) / 18 AS bin_start, lo + bin * (hi - lo) / 18 AS bin_end,
       count(*) AS configurations
       FROM (SELECT CAST(least(18, 1 + floor((CAST(co2_gap_to_class_p25 AS DOUBLE) - lo) / ((hi - lo) / 18))) AS INTEGER) AS bin, lo, hi
             FROM above, (SELECT CAST(min(co2_gap_to_class_p25) AS DOUBLE) AS lo, CAST(max(co2_gap_to_class_p25) AS DOUBLE) AS hi
                          FROM above))
       GROUP BY bin, lo, hi""",
    ABOVE,
)
def gap_histogram(spark, folder):
    return K.histogram(above(spark, folder), "co2_gap_to_class_p25")


@query(
    "top_gap_labels",
    "l_orderkey:l l_linenumber:l vehicle_label:s co2_gap_to_class_p25:d3",
    f"""SELECT *, make || ' — ' || model AS vehicle_label FROM above
        ORDER BY co2_gap_to_class_p25 DESC, {", ".join(TIE)} LIMIT 6""",
    ABOVE,
)
def top_gap_labels(spark, folder):
    return X.top_gap_labels(above(spark, folder), tie=TIE)


MEAN_GAP = "CAST(sum(co2_gap_to_class_p25) AS DOUBLE) / count(*)"


@query(
    "scenario",
    "configurations_screened:l average_gap:d scenario_tonnes:d",
    f"""SELECT count(*) AS configurations_screened, {MEAN_GAP} AS average_gap,
        {MEAN_GAP} * 20000 * 1000 / 1000000 AS scenario_tonnes FROM above""",
    ABOVE,
)
def scenario(spark, folder):
    return X.scenario(above(spark, folder))


@query(
    "scenario_sensitivity",
    "annual_km:l scenario_tonnes:d",
    f"""SELECT annual_km, average_gap * annual_km * 1000 / 1000000 AS scenario_tonnes
        FROM (SELECT {MEAN_GAP} AS average_gap FROM above), (SELECT unnest(range(5000, 50001, 5000)) AS annual_km)""",
    ABOVE,
)
def scenario_sensitivity(spark, folder):
    return X.sensitivity(above(spark, folder))


@query(
    "opportunity_page_kpis",
    "configurations_screened:l average_gap:d scenario_tonnes:d",
    f"""SELECT count(*) AS configurations_screened, {MEAN_GAP} AS average_gap,
        {MEAN_GAP} * 35000 * 2500 / 1000000 AS scenario_tonnes FROM exported
        WHERE vehicle_class IN ('COMPACT', 'SUV - SMALL') AND contains(lower(make), 'brand#1')""",
    EXPORTED,
)
def opportunity_page_kpis(spark, folder):
    chosen = P.Filters(classes=["COMPACT", "SUV - SMALL"], text="brand#1")
    return P.opportunity_page(exported(spark, folder), chosen, 35_000, 2_500, tie=TIE)["kpis"]


@query(
    "axis_bounds",
    "lowest:d highest:d",
    """SELECT least(min(fuel_cons_city_l_100km), min(fuel_cons_hwy_l_100km)) AS lowest,
       greatest(max(fuel_cons_city_l_100km), max(fuel_cons_hwy_l_100km)) AS highest FROM above""",
    ABOVE,
)
def axis_bounds(spark, folder):
    return X.axis_bounds(above(spark, folder), "fuel_cons_city_l_100km", "fuel_cons_hwy_l_100km")


@query(
    "latest_segment_labels",
    "vehicle_class:s segment_label:s records:l",
    """SELECT vehicle_class, 'Vehicle Class' AS segment_label, count(*) AS records FROM fact
       WHERE model_year = (SELECT max(model_year) FROM fact) GROUP BY vehicle_class""",
    PEERED,
)
def latest_segment_labels(spark, folder):
    latest = latest_only(R.ratings(spark, folder), "model_year").withColumn("segment_type", F.lit("vehicle_class"))
    labelled = P.labelled_segments(latest)
    return labelled.groupBy("vehicle_class", "segment_label").agg(F.count(F.lit(1)).alias("records"))


ENTITY_KEYS = ["model_year", "vehicle_class", "fuel_type"]


@query(
    "cube_distinct_parts",
    "model_year:l distinct_parts:l",
    f"SELECT model_year, count(DISTINCT l_partkey) AS distinct_parts FROM ratings WHERE {CHOSEN} GROUP BY model_year",
    (RATINGS,),
)
def cube_distinct_parts(spark, folder):
    cells = K.entity_cube(R.ratings(spark, folder), ENTITY_KEYS, "l_partkey")
    return K.distinct_entities(CHOICE.apply(cells), ["model_year"], "distinct_parts")


@query(
    "segment_kpis_distinct",
    "vehicle_configurations:l average_co2_g_km:d model_years:l distinct_entities:l",
    f"""SELECT (SELECT sum(vehicle_records) FROM cube WHERE {CHOSEN}) AS vehicle_configurations,
        (SELECT {weighted("average_co2_g_km")} FROM cube WHERE {CHOSEN}) AS average_co2_g_km,
        count(DISTINCT model_year) AS model_years, count(DISTINCT l_suppkey) AS distinct_entities
        FROM ratings WHERE {CHOSEN}""",
    CUBE,
)
def segment_kpis_distinct(spark, folder):
    cells = K.entity_cube(R.ratings(spark, folder), ENTITY_KEYS, "l_suppkey")
    return K.segment_kpis(CHOICE.apply(segments(spark, folder)), CHOICE.apply(cells))
