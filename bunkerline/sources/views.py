"""Input views over the given star-schema tables.

The text below is input data: it turns order lines, parts, orders and events into the
filings, vessels, plans and calls the operators work on. The same text runs on Spark and
on an ANSI engine, so both start from identical rows. Operators never share code with it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

VIEWS: dict[str, str] = {}

# One dirty text filing per order line: thousands separators, null and error tokens, an
# unparseable token, padded aliases, an unknown class, duplicates, zero hours, impossible Cf,
# a missing period, partial-year filings and gas columns that start in 2022.
VIEWS["v_filings"] = """
SELECT
  concat(lpad(CAST(l_orderkey AS STRING), 12, '0'), '-', CAST(l_linenumber AS STRING), '-',
         lpad(CAST(l_suppkey AS STRING), 9, '0'), '-',
         lpad(CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING), 14, '0'))   AS file_order,
  concat('filings_', CAST(yr AS STRING), '.csv')                        AS source_file,
  CASE WHEN l_discount > 0.095 THEN 'partial' ELSE 'full' END           AS report_coverage,
  1 + l_linenumber % 3                                                  AS file_version,
  CAST(1000000 + l_partkey AS STRING)                                   AS imo,
  CASE p_type WHEN 'STANDARD' THEN 'Bulk carrier'  WHEN 'LARGE'   THEN 'Oil tanker'
              WHEN 'SMALL'    THEN ' bulker '      WHEN 'ECONOMY' THEN 'Container ship'
              WHEN 'MEDIUM'   THEN 'Ro-pax ship'   ELSE 'Totally Unknown Vessel' END AS ship_type,
  CASE WHEN l_linenumber = 2 AND l_discount < 0.015 THEN NULL
       ELSE concat(CAST(yr AS STRING), '.0') END                        AS reporting_period,
  CASE WHEN p_size % 5 = 0 THEN 'Not Applicable'
       ELSE concat(CASE p_size % 3 WHEN 0 THEN 'EIV' WHEN 1 THEN 'eedi' ELSE 'EEXI' END,
                   ' (', CAST(p_size AS STRING), '.5 gCO2/t.nm)') END   AS technical_efficiency_raw,
  CASE WHEN p_size % 10 = 1 THEN 'IA' WHEN p_size % 10 = 2 THEN ' pc7'
       WHEN p_size % 10 = 3 THEN 'Not Applicable' WHEN p_size % 10 = 4 THEN 'N/A' END AS ice_class,
  CASE WHEN fuel_k >= 1000
       THEN concat(CAST(CAST(floor(fuel_k / 1000) AS INT) AS STRING), ',',
                   lpad(CAST(fuel_k % 1000 AS STRING), 3, '0'))
       WHEN fuel_k < 120 THEN ' - ' ELSE CAST(fuel_k AS STRING) END      AS total_fuel_t,
  CASE WHEN l_returnflag = 'N' THEN NULL
       ELSE CAST(CAST(floor(fuel_k * 0.6) AS INT) AS STRING) END        AS laden_fuel_t,
  CAST(CAST(floor(fuel_k * cf_mil / 1000) AS INT) AS STRING)            AS total_co2_t,
  CASE WHEN yr >= 2022 THEN CAST(CAST(floor(fuel_k * (p_size % 7) / 50) AS INT) AS STRING) END AS co2_at_berth_t,
  CASE WHEN yr >= 2022 THEN CAST(CAST(l_quantity AS INT) AS STRING) END AS total_ch4_t,
  CASE WHEN yr >= 2022 THEN CAST(l_linenumber AS STRING) END            AS total_n2o_t,
  CASE WHEN yr >= 2022 THEN CAST(CAST(floor(fuel_k * cf_mil / 1000) AS INT)
       + 28 * CAST(l_quantity AS INT) + 265 * l_linenumber AS STRING) END AS total_co2eq_t,
  CASE WHEN l_linenumber = 6 THEN '0' ELSE CAST(1000 + 100 * (p_size + l_linenumber) AS STRING) END AS time_at_sea_h,
  CASE WHEN p_size % 10 = 1 THEN '24' ELSE 'N/A' END                    AS time_at_sea_ice_h,
  CASE WHEN l_linenumber = 5 THEN 'Division by zero!'
       ELSE CAST(40 + 4 * CAST(l_quantity AS INT) AS STRING) END        AS fuel_per_distance_kg_per_nmi,
  CASE WHEN l_linenumber = 4 THEN 'N/A'
       WHEN l_linenumber = 3 AND p_size = 13 THEN 'see note'
       ELSE CAST(5 + p_size % 20 AS STRING) END                         AS fuel_per_work_mass_g_per_t_nmi,
  CASE WHEN l_linenumber = 4 AND p_size % 2 = 0 THEN CAST(4 + p_size % 10 AS STRING)
       ELSE 'Not Applicable' END                                        AS fuel_per_work_dwt_g_per_dwt_nmi,
  CAST(CAST(floor((40 + 4 * CAST(l_quantity AS INT)) * cf_mil / 1000) AS INT) AS STRING) AS co2_per_distance_kg_per_nmi
FROM (
  SELECT l.*, p.p_type, p.p_size,
         CAST(floor(l_extendedprice / 10) AS INT)                       AS fuel_k,
         CASE WHEN l_linenumber = 7 AND l_discount < 0.02 THEN 5000
              ELSE 2600 + CAST(round(l_tax * 7500) AS INT) END          AS cf_mil,
         CAST(2018 + year(l_shipdate) - 1995 AS INT)                    AS yr
  FROM {lineitem} l JOIN {part} p ON p_partkey = l_partkey) k
"""

# A candidate fleet: every part is a vessel.
VIEWS["v_vessel"] = """
SELECT p_partkey                                                   AS vessel_key,
       concat('V', lpad(CAST(p_partkey AS STRING), 9, '0'))        AS vessel,
       CASE WHEN p_size % 3 = 0 THEN 'general_cargo' ELSE 'bulk_carrier' END AS vessel_class,
       CAST(5000 + 700 * p_size AS DOUBLE)                         AS capacity_t,
       CASE WHEN p_size % 7 = 0 THEN NULL ELSE CAST(8 + p_size % 22 AS DOUBLE) END AS design_efficiency_gco2_per_t_nmi,
       CAST(8 AS DOUBLE)                                           AS min_speed_kn,
       CAST(13 + p_size % 5 AS DOUBLE)                             AS max_speed_kn,
       CAST(60 + 9 * p_size AS DOUBLE)                             AS tank_volume_m3,
       CAST(60000000 + 6000000 * p_size AS DOUBLE)                 AS annual_cost_inr,
       CASE WHEN p_size = 50 THEN CAST(30 AS DOUBLE) ELSE CAST(6000 + 30 * p_size AS DOUBLE) END AS available_hours,
       CASE WHEN p_size % 11 = 0 THEN 'Mumbai-Cochin|Mumbai-Mormugao' END AS compatible_routes_text,
       CASE WHEN p_size % 13 = 0 THEN 'mgo|hfo' END                AS compatible_fuels_text
FROM {part}
"""

# Random plans: an order is a plan, the parts on its lines are the deployed vessels. Speeds
# run a little outside the bounds so that clamping shows.
VIEWS["v_plan"] = """
SELECT plan_id, vessel_key, vessel,
       CAST(floor({U:route} * 3) AS INT)                           AS route_idx,
       CAST(floor({U:fuel} * 4) AS INT)                            AS fuel_idx,
       7.5 + {U:speed} * 10.0                                      AS speed_kn
FROM (SELECT DISTINCT l_orderkey AS plan_id, l_partkey AS vessel_key,
             concat('V', lpad(CAST(l_partkey AS STRING), 9, '0')) AS vessel,
             concat('1000-', CAST(l_orderkey AS STRING), '-', CAST(l_partkey AS STRING)) AS k
      FROM {lineitem}) p
"""

# Shaft work to be met with one fuel each.
VIEWS["v_activity"] = """
SELECT concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING),
              '-', CAST(l_suppkey AS STRING), '-', CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING)) AS activity_id,
       CASE (l_partkey + l_linenumber) % 15
            WHEN 0 THEN 'hfo' WHEN 1 THEN 'mgo' WHEN 2 THEN 'mgo' WHEN 3 THEN 'lng' WHEN 4 THEN 'lng'
            WHEN 5 THEN 'methanol' WHEN 6 THEN 'methanol' WHEN 7 THEN 'methanol'
            WHEN 8 THEN 'ammonia' WHEN 9 THEN 'ammonia' WHEN 10 THEN 'ammonia'
            WHEN 11 THEN 'hydrogen' WHEN 12 THEN 'hydrogen' WHEN 13 THEN 'hydrogen' ELSE 'electricity' END AS fuel,
       CASE (l_partkey + l_linenumber) % 15
            WHEN 0 THEN 'fossil' WHEN 1 THEN 'fossil' WHEN 2 THEN 'bio' WHEN 3 THEN 'fossil' WHEN 4 THEN 'bio_lbg'
            WHEN 5 THEN 'fossil' WHEN 6 THEN 'bio' WHEN 7 THEN 'e_fuel'
            WHEN 8 THEN 'grey' WHEN 9 THEN 'blue' WHEN 10 THEN 'green'
            WHEN 11 THEN 'grey' WHEN 12 THEN 'blue' WHEN 13 THEN 'green' END AS pathway,
       CASE l_suppkey % 8 WHEN 1 THEN 'otto_medium_speed' WHEN 2 THEN 'otto_slow_speed'
            WHEN 3 THEN 'diesel_slow_speed' WHEN 4 THEN 'diesel_medium_speed' WHEN 5 THEN 'lbsi'
            WHEN 6 THEN 'steam_turbine' WHEN 7 THEN 'fleet_measured' END AS engine,
       l_extendedprice * l_quantity                                AS energy_mj,
       CAST(2024 + l_suppkey % 27 AS INT)                          AS year,
       l_linenumber                                                AS line
FROM {lineitem}
"""

# Berth calls and bunkering questions: one per order.
VIEWS["v_berth"] = """
SELECT o_orderkey AS call_id,
       CASE o_orderkey % 8 WHEN 0 THEN 'mormugao' WHEN 1 THEN 'deendayal' WHEN 2 THEN 'paradip'
            WHEN 3 THEN 'vo_chidambaranar' WHEN 4 THEN 'jnpa' WHEN 5 THEN 'visakhapatnam'
            WHEN 6 THEN 'cochin' ELSE 'mumbai' END                 AS port,
       CASE o_custkey % 9 WHEN 0 THEN 'hfo' WHEN 1 THEN 'mgo' WHEN 2 THEN 'lng' WHEN 3 THEN 'methanol'
            WHEN 4 THEN 'ammonia' WHEN 5 THEN 'hydrogen' WHEN 6 THEN 'electricity'
            WHEN 7 THEN 'mgo' ELSE 'coal' END                      AS fuel,
       CAST(2020 + o_custkey % 31 AS INT)                          AS year,
       o_totalprice                                                AS energy_mj,
       CAST(floor(o_orderkey / 8) AS BIGINT) % 2 = 0               AS vessel_equipped
FROM {orders}
"""

# Legs sailed: one per order, over one of eight two- or three-port routes.
VIEWS["v_leg"] = """
SELECT o_orderkey AS leg_id,
       CASE o_custkey % 8 WHEN 0 THEN 'mumbai|cochin' WHEN 1 THEN 'mumbai|mormugao'
            WHEN 2 THEN 'cochin|vo_chidambaranar' WHEN 3 THEN 'deendayal|mumbai'
            WHEN 4 THEN 'paradip|visakhapatnam' WHEN 5 THEN 'jnpa|cochin'
            WHEN 6 THEN 'deendayal|jnpa|vo_chidambaranar' ELSE 'mormugao|jnpa|cochin' END AS ports_text,
       CASE o_orderkey % 7 WHEN 0 THEN 'hfo' WHEN 1 THEN 'mgo' WHEN 2 THEN 'lng' WHEN 3 THEN 'methanol'
            WHEN 4 THEN 'ammonia' WHEN 5 THEN 'hydrogen' ELSE 'electricity' END AS fuel,
       CAST(2022 + o_custkey % 29 AS INT)                          AS year,
       CAST(200 + o_custkey % 4000 AS DOUBLE)                      AS route_nmi,
       1500.0 + o_totalprice / 100.0                               AS energy_per_nmi_mj,
       CAST(100 + o_orderkey % 4000 AS DOUBLE)                     AS tank_volume_m3,
       o_totalprice                                                AS emissions_t,
       CAST(10000 + 37 * (o_custkey % 1000) AS DOUBLE)             AS cargo_t,
       4.0 + o_orderkey % 10                                       AS baseline_intensity
FROM {orders}
"""

# Scored predictions: one per event.
VIEWS["v_prediction"] = """
SELECT event_id, CASE WHEN user_id % 17 = 0 THEN NULL ELSE event_type END AS grp,
       CASE WHEN event_id % 50 = 0 THEN 0.0 ELSE value END         AS actual,
       CASE WHEN event_id % 41 = 0 THEN NULL ELSE value * (0.8 + 0.4 * {U:pred}) END AS predicted,
       value * (0.8 + 0.4 * {U:pred}) * 0.85                       AS p10,
       value * (0.8 + 0.4 * {U:pred}) * 1.15                       AS p90,
       CASE WHEN event_id % 97 = 0 THEN NULL ELSE value * (0.7 + 0.5 * {U:alt}) END AS alternative,
       CAST(1000 + user_id % 30 AS INT)                            AS seed
FROM (SELECT *, CAST(event_id AS STRING) AS k FROM {events}) e
"""

# Scored plans to compare: one per order, three objectives, several algorithms.
VIEWS["v_front"] = """
SELECT o_orderkey AS plan_id, o_orderpriority AS algorithm,
       o_totalprice                                                AS energy,
       round(1000000.0 * {U:em} + 50000000000.0 / o_totalprice)     AS emissions,
       round(1000000.0 * {U:cost})                                 AS cost,
       CASE WHEN o_orderkey % 10 = 0 THEN 0.25 + (o_custkey % 7) / 10.0 ELSE 0.0 END AS violation
FROM (SELECT *, CAST(o_orderkey AS STRING) AS k FROM {orders}) o
"""

# A measured quantity with the unit it was written in.
VIEWS["v_unit"] = """
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS value,
       CASE l_partkey % 40
            WHEN 0 THEN 'kn' WHEN 1 THEN '[m/s]' WHEN 2 THEN 'km/h' WHEN 3 THEN 'mph' WHEN 4 THEN 'nmi'
            WHEN 5 THEN 'km' WHEN 6 THEN 'm' WHEN 7 THEN 'mi' WHEN 8 THEN 'h' WHEN 9 THEN 'min'
            WHEN 10 THEN 's' WHEN 11 THEN 'days' WHEN 12 THEN 't' WHEN 13 THEN ' (kg) ' WHEN 14 THEN 'g'
            WHEN 15 THEN 'lb' WHEN 16 THEN 'm³' WHEN 17 THEN 'm3' WHEN 18 THEN 'litre' WHEN 19 THEN 'bbl'
            WHEN 20 THEN 'MJ' WHEN 21 THEN 'kJ' WHEN 22 THEN 'GJ' WHEN 23 THEN 'kWh' WHEN 24 THEN 'MWh'
            WHEN 25 THEN 'kW' WHEN 26 THEN 'W' WHEN 27 THEN 'MW' WHEN 28 THEN 'hp' WHEN 29 THEN 'tCO2e'
            WHEN 30 THEN 'kgCO2e' WHEN 31 THEN 'ktCO2e' WHEN 32 THEN 'mt' WHEN 33 THEN 'Tons' WHEN 34 THEN 'cbm'
            WHEN 35 THEN 'kt' WHEN 36 THEN 'tpd' WHEN 37 THEN 'furlong' WHEN 38 THEN 'mj' ELSE '' END AS unit,
       CASE WHEN l_partkey % 40 < 4 THEN 'speed' WHEN l_partkey % 40 < 8 THEN 'distance'
            WHEN l_partkey % 40 < 12 THEN 'time' WHEN l_partkey % 40 < 16 THEN 'mass'
            WHEN l_partkey % 40 < 20 THEN 'volume' WHEN l_partkey % 40 < 25 THEN 'energy'
            WHEN l_partkey % 40 < 29 THEN 'power' WHEN l_partkey % 40 < 32 THEN 'emission'
            WHEN l_partkey % 40 < 34 THEN 'mass' WHEN l_partkey % 40 < 35 THEN 'volume'
            WHEN l_partkey % 40 < 37 THEN 'mass' WHEN l_partkey % 40 < 38 THEN 'distance'
            ELSE 'energy' END                                      AS dimension,
       CASE l_suppkey % 8
            WHEN 0 THEN 'Speed over ground (kn)' WHEN 1 THEN 'Distance sailed [nmi] ' WHEN 2 THEN 'Fuel (mt)'
            WHEN 3 THEN 'Time at sea' WHEN 4 THEN 'Energy (total) [GJ]' WHEN 5 THEN 'Bunker volume [m³]'
            WHEN 6 THEN 'Power (bhp)' ELSE 'Cargo (stones)' END    AS header,
       CASE l_suppkey % 8
            WHEN 0 THEN 'speed' WHEN 1 THEN 'distance' WHEN 2 THEN 'mass' WHEN 3 THEN 'time'
            WHEN 4 THEN 'energy' WHEN 5 THEN 'volume' WHEN 6 THEN 'power' ELSE 'mass' END AS header_dimension
FROM {lineitem}
"""

_UNIFORM = re.compile(r"\{U:(\w+)\}")


def portable_sql(name: str) -> str:
    """The view for an ANSI engine with the base tables in scope."""
    text = _UNIFORM.sub(
        r"(CAST('0x' || substr(md5(concat(k, '-\1')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)",
        VIEWS[name],
    )
    for table in BASE_TABLES:
        text = text.replace("{" + table + "}", table)
    return text


def read_view(spark: SparkSession, name: str, tables: dict[str, DataFrame]) -> DataFrame:
    text = _UNIFORM.sub(
        r"(CAST(conv(substr(md5(concat(k, '-\1')), 1, 8), 16, 10) AS BIGINT) / 4294967296.0D)",
        VIEWS[name],
    )
    used = {t: tables[t] for t in BASE_TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)
