"""Queries over reading, cleaning and deriving the ship-year panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from bunkerline import dims
from bunkerline import reference as ref
from bunkerline.functions.expr import rnd
from bunkerline.operators import derive, emissions, features
from bunkerline.plans.registry import Inputs, cte, query, values_cte
from bunkerline.sources import filings as src
from bunkerline.sources import panel_store, sinks
from bunkerline.sources.drops import DECLARED, read_drops

# --------------------------------------------------------------------------- oracle tables
NULLS = "('', 'n/a', 'na', 'not applicable', 'not available', '-', 'none')"
ERRORS = "('division by zero!', '#div/0!', 'div/0!', '#value!', '#n/a', 'nan')"
NUMERIC = [
    "total_fuel_t", "laden_fuel_t", "total_co2_t", "co2_at_berth_t", "total_ch4_t", "total_n2o_t",
    "total_co2eq_t", "time_at_sea_h", "time_at_sea_ice_h", "fuel_per_distance_kg_per_nmi",
    "fuel_per_work_mass_g_per_t_nmi", "fuel_per_work_dwt_g_per_dwt_nmi", "co2_per_distance_kg_per_nmi",
]


def num(c: str) -> str:
    return (
        f"CASE WHEN lower(trim({c})) IN {NULLS} OR lower(trim({c})) IN {ERRORS} THEN NULL "
        f"ELSE TRY_CAST(replace(trim({c}), ',', '') AS DOUBLE) END"
    )


cte("o_clean", f"""
SELECT file_order, source_file, report_coverage, TRY_CAST(trim(imo) AS BIGINT) AS imo, trim(ship_type) AS ship_type,
  COALESCE(CAST(round({num('reporting_period')}) AS INTEGER),
           CAST(regexp_extract(source_file, '(19|20)[0-9][0-9]', 0) AS INTEGER)) AS reporting_period,
  trim(technical_efficiency_raw) AS technical_efficiency_raw,
  CASE WHEN ice_class = 'N/A' THEN NULL ELSE trim(ice_class) END AS ice_class,
  {', '.join(f'{num(c)} AS {c}' for c in NUMERIC)}
FROM v_filings WHERE report_coverage = 'full'""")

FILLED = " + ".join(
    f"CAST({c} IS NOT NULL AS INTEGER)"
    for c in ["imo", "ship_type", "reporting_period", "technical_efficiency_raw", "ice_class", *NUMERIC]
)
cte("o_panel", f"""
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY imo, reporting_period ORDER BY {FILLED} DESC, file_order DESC) AS keep
  FROM o_clean WHERE imo IS NOT NULL AND total_fuel_t IS NOT NULL) WHERE keep = 1""")

cte("o_speed", """
SELECT *, CASE WHEN time_at_sea_h > 0 THEN distance_nmi / time_at_sea_h END AS mean_speed_kn FROM (
  SELECT *, CASE WHEN fuel_per_distance_kg_per_nmi > 0
                 THEN total_fuel_t * 1000.0 / fuel_per_distance_kg_per_nmi END AS distance_nmi FROM o_panel)""")
cte("o_energy", """
SELECT *, CASE WHEN time_at_sea_h > 0 THEN energy_mj / time_at_sea_h / 3.6e0 END AS mean_power_kw,
  CASE WHEN distance_nmi > 0 THEN energy_mj / distance_nmi END AS energy_per_nmi_mj
FROM (SELECT *, total_fuel_t * 1000.0 * inferred_lhv_mj_per_kg AS energy_mj FROM (
  SELECT *, CASE WHEN cf IS NULL THEN NULL WHEN cf < 3.114e0
        THEN 48e0 + greatest(0e0, least(1e0, (cf - 2.75e0) / (3.114e0 - 2.75e0))) * (40.2e0 - 48e0)
        ELSE 40.2e0 + greatest(0e0, least(1e0, (cf - 3.114e0) / (3.206e0 - 3.114e0))) * (42.7e0 - 40.2e0) END AS inferred_lhv_mj_per_kg,
    CASE WHEN cf IS NULL THEN NULL WHEN cf < 3.114e0
        THEN greatest(0e0, least(1e0, (cf - 2.75e0) / (3.114e0 - 2.75e0)))
        ELSE greatest(0e0, least(1e0, (cf - 3.114e0) / (3.206e0 - 3.114e0))) END AS inferred_blend_fraction
  FROM (SELECT *, CASE WHEN total_fuel_t > 0 THEN total_co2_t / total_fuel_t END AS cf FROM o_speed)))""")
cte("o_derived", """
SELECT *, NOT (f_cf OR f_speed OR f_time OR f_fuel OR f_power OR f_cargo OR f_zero OR f_negative)
    AND COALESCE(mean_power_kw > 0, FALSE) AND mean_speed_kn IS NOT NULL AS is_usable
FROM (SELECT *,
    COALESCE(cf < 2.4e0 OR cf > 3.3e0, FALSE) AS f_cf,
    COALESCE(mean_speed_kn < 1 OR mean_speed_kn > 30, FALSE) AS f_speed,
    COALESCE(time_at_sea_h < 0 OR time_at_sea_h > 8784, FALSE) AS f_time,
    COALESCE(total_fuel_t < 0 OR total_fuel_t > 500000, FALSE) AS f_fuel,
    COALESCE(mean_power_kw < 0 OR mean_power_kw > 120000, FALSE) AS f_power,
    COALESCE(cargo_carried_t < 1 OR cargo_carried_t > 600000, FALSE) AS f_cargo,
    COALESCE(time_at_sea_h > 0 AND total_fuel_t <= 0, FALSE) AS f_zero,
    COALESCE(total_fuel_t < 0, FALSE) AS f_negative
  FROM (SELECT *,
    COALESCE(CASE WHEN fuel_per_work_mass_g_per_t_nmi > 0 THEN fuel_per_distance_kg_per_nmi * 1000.0 / fuel_per_work_mass_g_per_t_nmi END,
             CASE WHEN fuel_per_work_dwt_g_per_dwt_nmi > 0 THEN fuel_per_distance_kg_per_nmi * 1000.0 / fuel_per_work_dwt_g_per_dwt_nmi END) AS cargo_carried_t,
    CASE WHEN fuel_per_work_mass_g_per_t_nmi > 0 AND fuel_per_distance_kg_per_nmi IS NOT NULL THEN 'mass'
         WHEN fuel_per_work_dwt_g_per_dwt_nmi > 0 AND fuel_per_distance_kg_per_nmi IS NOT NULL THEN 'dwt' ELSE 'none' END AS cargo_basis,
    upper(nullif(regexp_extract(technical_efficiency_raw, '(?i)(EIV|EEDI|EEXI)\\s*\\(\\s*([0-9.]+)\\s*g', 1), '')) AS metric,
    TRY_CAST(nullif(regexp_extract(technical_efficiency_raw, '(?i)(EIV|EEDI|EEXI)\\s*\\(\\s*([0-9.]+)\\s*g', 2), '') AS DOUBLE) AS design
  FROM o_energy))""")
cte("o_usable", "SELECT * FROM o_derived WHERE is_usable")
values_cte("o_alias", "label string, vessel_class string", dims.alias_rows())
values_cte(
    "o_class",
    "vessel_class string, display_name string, reference_speed_kn double, aux_share double, in_scope boolean",
    dims.class_rows(),
)
values_cte("o_fuel", ref.FUEL_COLUMNS, ref.FUELS)
values_cte("o_pathway", ref.PATHWAY_COLUMNS, ref.PATHWAYS)
values_cte("o_slip", ref.SLIP_COLUMNS, ref.SLIPS)
values_cte("o_sliprange", ref.SLIP_RANGE_COLUMNS, ref.SLIP_RANGES)
values_cte("o_gwp", ref.GWP_COLUMNS, ref.GWP_SETS)
values_cte("o_avail", "port string, fuel string, year int, status string", ref.AVAILABILITY)
values_cte("o_shore", ref.SHORE_POWER_COLUMNS, ref.SHORE_POWER)
values_cte("o_port", ref.PORT_COLUMNS, ref.PORTS)
values_cte("o_unitdim", "dimension string, unit string, factor double",
           [(d, u, f) for d, t in ref.UNIT_FACTORS.items() for u, f in t.items()])

# --------------------------------------------------------------------------- 2.1 sources


@query("src_coverage_filter", """
SELECT report_coverage, CAST(year AS INTEGER) AS reporting_period, count(*) AS filings FROM (
  SELECT report_coverage, regexp_extract(source_file, '[0-9]{4}', 0) AS year FROM v_filings) GROUP BY ALL""")
def _(t: Inputs):
    period = F.regexp_extract("source_file", src.PERIOD_PATTERN, 0).cast("int")
    known = src.typed_filings(t.filings.where(F.col("report_coverage").isin("full", "partial")))
    return known.groupBy("report_coverage", period.alias("reporting_period")).agg(F.count(F.lit(1)).alias("filings"))


META = ["file_order", "source_file", "report_coverage", "file_version"]
EARLY = {  # published header each declared column has in the older layout
    "time_at_sea_h": "Time spent at sea  [hours]",
    "laden_fuel_t": "Fuel consumption assigned to On laden [m tonnes]",
    "fuel_per_distance_kg_per_nmi": "Fuel consumption per distance [kg / n mile]",
}


def layouts(t: Inputs):
    """The filings as two published layouts: older headers up to 2021, current ones after."""
    declared = {n: h for n, h, *_ in ref.FILING_COLUMNS}
    present = [c for c in t.filings.columns if c in declared]
    gases = {"co2_at_berth_t", "total_ch4_t", "total_n2o_t", "total_co2eq_t"}
    year = F.regexp_extract("source_file", r"\d{4}", 0).cast("int")
    old = t.filings.where(year <= 2021).select(
        *META, *[F.col(c).alias(EARLY.get(c, declared[c])) for c in reversed(present) if c not in gases],
        F.lit("x").alias("Verifier Name"),
    )
    new = t.filings.where(year > 2021).select(
        *META, *[F.col(c).alias(declared[c].upper().replace("CO2 ", "CO₂ ")) for c in present]
    )
    return old, new


def drops(t: Inputs) -> str:
    """Both layouts as folders of drops, one a period: CSV up to 2021, Parquet after."""
    def write(path: str) -> None:
        old, new = layouts(t)
        meta = [c for c in META if c not in ("source_file", "file_version")]  # path and name tell these
        period = F.regexp_extract("source_file", r"\d{4}", 0).alias("period")
        old = old.select(period, *meta, *[src.quoted(c) for c in old.columns if c not in META])
        new = new.select(period, *meta, *[src.quoted(c) for c in new.columns if c not in META])
        old.write.partitionBy("period").options(
            header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(f"{path}/csv")
        new.write.partitionBy("period").parquet(f"{path}/parquet")

    return t.folder_of("drops", write)


@query("src_period_scan", f"""
SELECT CAST(regexp_extract(source_file, '[0-9]{{4}}', 0) AS INTEGER) AS file_period, count(*) AS rows_read, count(reporting_period) AS rows_with_period,
       count(DISTINCT imo) AS ships, count(time_at_sea_h) AS with_time, count(total_ch4_t) AS with_ch4, count(ship_name) AS with_name,
       count(DISTINCT file_order) AS places
FROM (SELECT *, CAST(NULL AS VARCHAR) AS ship_name FROM v_filings) GROUP BY 1""")
def _(t: Inputs):
    # distinct ships and places by two-step aggregates, so one period may hold most rows
    rows = read_drops(t.spark, drops(t), keep=("file_order",))
    per_place = rows.groupBy("file_period", "imo", "file_order").agg(
        F.count(F.lit(1)).alias("n"), *[F.count(c).alias(c) for c in ("reporting_period", "time_at_sea_h", "total_ch4_t", "ship_name")])
    sums = [F.sum(c).alias(c) for c in ("n", "reporting_period", "time_at_sea_h", "total_ch4_t", "ship_name")]
    per_ship = per_place.groupBy("file_period", "imo").agg(*sums, F.count(F.lit(1)).alias("places"))
    return per_ship.groupBy("file_period").agg(
        F.sum("n").alias("rows_read"), F.sum("reporting_period").alias("rows_with_period"), F.count("imo").alias("ships"),
        F.sum("time_at_sea_h").alias("with_time"), F.sum("total_ch4_t").alias("with_ch4"), F.sum("ship_name").alias("with_name"),
        F.sum("places").alias("places"))


@query("src_header_resolve", f"""
SELECT reporting_period, count(*) AS filings, count(time_at_sea_h) AS with_time, count(laden_fuel_t) AS with_laden,
       count(total_ch4_t) AS with_ch4, CAST(sum(fuel_per_distance_kg_per_nmi) AS DOUBLE) AS fpd_sum
FROM (SELECT CAST(regexp_extract(source_file, '[0-9]{{4}}', 0) AS INTEGER) AS reporting_period,
        {num('time_at_sea_h')} AS time_at_sea_h, {num('laden_fuel_t')} AS laden_fuel_t, {num('total_ch4_t')} AS total_ch4_t,
        {num('fuel_per_distance_kg_per_nmi')} AS fuel_per_distance_kg_per_nmi FROM v_filings)
GROUP BY reporting_period""")
def _(t: Inputs):
    old, new = layouts(t)
    stacked = src.apply_headers(old, META).unionByName(src.apply_headers(new, META))
    return src.typed_filings(stacked).groupBy(
        F.regexp_extract("source_file", r"\d{4}", 0).cast("int").alias("reporting_period")
    ).agg(
        F.count(F.lit(1)).alias("filings"), F.count("time_at_sea_h").alias("with_time"),
        F.count("laden_fuel_t").alias("with_laden"), F.count("total_ch4_t").alias("with_ch4"),
        F.sum("fuel_per_distance_kg_per_nmi").alias("fpd_sum"),
    )


ABSENT = ["ship_name", "fuel_per_hour_t_per_h", "fuel_per_work_pax_g_per_pax_nmi",
          "fuel_per_work_volume_g_per_m3_nmi", "co2_per_work_mass_g_per_t_nmi",
          "laden_fuel_per_distance_kg_per_nmi", "through_ice_nmi", "cargo_density_t_per_m3"]
OLD_ABSENT = [*ABSENT, "co2_at_berth_t", "total_ch4_t", "total_n2o_t", "total_co2eq_t"]


@query("src_missing_columns", f"""
SELECT f.layout, s.status, s.name, f.filings FROM (
  SELECT CASE WHEN CAST(regexp_extract(source_file, '[0-9]{{4}}', 0) AS INTEGER) <= 2021 THEN 'old' ELSE 'new' END AS layout,
         count(*) AS filings FROM v_filings GROUP BY 1) f
JOIN (SELECT * FROM (VALUES
  {', '.join(f"('old', 'missing', '{c}')" for c in OLD_ABSENT)},
  {', '.join(f"('new', 'missing', '{c}')" for c in ABSENT)},
  ('old', 'unconsumed', 'Verifier Name'),
  {', '.join(f"('old', 'alias', '{c}')" for c in EARLY)}) v(layout, status, name)) s ON s.layout = f.layout""")
def _(t: Inputs):
    from bunkerline.functions.expr import inline_table

    old, new = layouts(t)
    found = src.header_report({
        "old": [c for c in old.columns if c not in META], "new": [c for c in new.columns if c not in META]
    })
    rows = [
        (layout, status, name or header) for layout, name, status, header in found if status != "primary"
    ]
    report = inline_table(t.spark, "layout string, status string, name string", rows)
    sizes = old.select(F.lit("old").alias("layout")).unionAll(new.select(F.lit("new").alias("layout")))
    return sizes.groupBy("layout").agg(F.count(F.lit(1)).alias("filings")).join(F.broadcast(report), "layout")


@query("src_union_periods", f"""
SELECT reporting_period, count(*) AS filings, count(total_ch4_t) AS with_ch4,
       CAST(sum(total_co2_t) AS DOUBLE) AS co2_t FROM (
  SELECT COALESCE(CAST(round({num('reporting_period')}) AS INTEGER), CAST(regexp_extract(source_file, '[0-9]{{4}}', 0) AS INTEGER)) AS reporting_period,
         {num('total_ch4_t')} AS total_ch4_t, {num('total_co2_t')} AS total_co2_t FROM v_filings)
WHERE reporting_period IN (2019, 2021, 2022, 2024) GROUP BY reporting_period""")
def _(t: Inputs):
    both = src.union_periods(layouts(t), META, periods=(2019, 2021, 2022, 2024))
    return both.groupBy("reporting_period").agg(
        F.count(F.lit(1)).alias("filings"), F.count("total_ch4_t").alias("with_ch4"),
        F.sum("total_co2_t").alias("co2_t"),
    )


@query("src_period_backfill", """
SELECT source_file, reporting_period, count(*) AS filings FROM o_clean GROUP BY ALL""")
def _(t: Inputs):
    return t.typed.groupBy("source_file", "reporting_period").agg(F.count(F.lit(1)).alias("filings"))


@query("src_latest_version", """
SELECT source_file, file_version, count(*) AS filings FROM (
  SELECT *, max(file_version) OVER (PARTITION BY source_file) AS newest FROM v_filings)
WHERE file_version = newest GROUP BY ALL""")
def _(t: Inputs):
    kept = src.latest_version(t.filings, period="source_file")
    return kept.groupBy("source_file", "file_version").agg(F.count(F.lit(1)).alias("filings"))


@query("src_input_manifest")
def _(t: Inputs):
    return src.input_manifest(t.spark, t.folder, "*.parquet")


@query("src_reference_dims", """
SELECT c.vessel_class, c.display_name, c.reference_speed_kn, c.aux_share, c.in_scope,
       count(f.imo) AS filings, count(DISTINCT f.imo) AS ships
FROM o_class c LEFT JOIN (SELECT imo, COALESCE(a.vessel_class, 'other') AS vessel_class
  FROM v_filings LEFT JOIN o_alias a ON a.label = lower(trim(ship_type))) f ON f.vessel_class = c.vessel_class
GROUP BY ALL""")
def _(t: Inputs):
    used = features.resolve_class(t.filings.select("imo", "ship_type")).groupBy("vessel_class", "imo").agg(
        F.count(F.lit(1)).alias("n")
    ).groupBy("vessel_class").agg(F.sum("n").alias("filings"), F.count("imo").alias("ships"))
    return t.dim("classes").join(used, "vessel_class", "left").fillna(0, ["filings", "ships"])


@query("src_dims_validate", """
SELECT 'alias_claimed_twice' AS rule, label AS subject, count(DISTINCT ship) AS ships FROM (
  SELECT lower(trim(ship_type)) AS label, imo AS ship,
         CASE WHEN CAST(imo AS BIGINT) % 2 = 0 THEN 'even' ELSE 'odd' END AS owner FROM v_filings)
GROUP BY label HAVING count(DISTINCT owner) > 1""")
def _(t: Inputs):
    # the rules run on the fuel tables as shipped plus an alias table observed in the data, in
    # which even and odd ships file the same labels: only that observed clash may be reported
    observed = t.filings.select(
        F.lower(F.trim("ship_type")).alias("label"), "imo",
        F.when(F.col("imo").cast("bigint") % 2 == 0, "even").otherwise("odd").alias("vessel_class"),
    )
    found = dims.violations(
        t.dim("fuels"), t.dim("pathways"), t.dim("pilots"), t.dim("slips"),
        observed, t.dim("gwp_sets"), ref.DEFAULT_GWP_SET,
    )
    ships = observed.groupBy("label", "imo").agg(F.lit(1).alias("one")).groupBy(
        F.col("label").alias("subject")).agg(F.sum("one").alias("ships"))
    return found.join(ships, "subject", "left").select("rule", "subject", "ships")


@query("sink_parquet_panel", """
SELECT reporting_period, count(*) AS rows, count(*) FILTER (is_usable) AS usable FROM o_derived GROUP BY ALL""")
def _(t: Inputs):
    return t.stored.groupBy("reporting_period").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("is_usable").alias("usable")
    )


BEST_FILLED = FILLED.replace("\n", " ")


@query("sink_panel_refresh", f"""
SELECT reporting_period, count(*) AS rows, count(DISTINCT imo) AS ships, CAST(sum({BEST_FILLED}) AS BIGINT) AS cells FROM o_panel GROUP BY ALL""")
def _(t: Inputs):
    # the versioned panel of the drops; ties between equally filled rows may fall otherwise than by order line
    root = t.folder_of("panel_store", lambda path: panel_store.refresh(t.spark, drops(t), path) and None)
    rows = panel_store.read_panel(t.spark, root)
    cells = sum((F.col(c).isNotNull().cast("int") for c in DECLARED), F.lit(0))
    return rows.groupBy("reporting_period").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("imo").alias("ships"), F.sum(cells).alias("cells"))


@query("sink_run_context")
def _(t: Inputs):
    inputs = t.usable.agg(
        F.count(F.lit(1)).alias("rows"), F.min("reporting_period").alias("first_period"),
        F.max("reporting_period").alias("last_period"),
    )
    return sinks.run_context(inputs, seed=1000, stage="panel")


CARD_PARAMS = {"trees": 400, "depth": 6, "rate": 0.05}  # the published ensemble


@query("sink_model_card", """
SELECT count(*) AS n_rows, count(DISTINCT imo) AS n_ships,
       array_to_string(list_sort(list_distinct(list(CAST(reporting_period AS VARCHAR)))), ',') AS periods,
       11 AS n_features, 'vessel_class,design_efficiency_gco2_per_t_nmi,has_design_efficiency,efficiency_metric_eiv,efficiency_metric_eedi,efficiency_metric_eexi,has_ice_class,ice_class_ordinal,ice_time_share,reporting_period,time_at_sea_h' AS features,
       '{"depth": 6, "rate": 0.05, "trees": 400}' AS params, 'grouped out-of-fold log residuals' AS interval_method
FROM o_usable WHERE inferred_lhv_mj_per_kg * fuel_per_distance_kg_per_nmi > 0""")
def _(t: Inputs):
    card = sinks.model_card(features.with_target(t.usable).where("target > 0"), CARD_PARAMS)
    return card.select("n_rows", "n_ships", "periods", "n_features", "features", "params", "interval_method")


# --------------------------------------------------------------------------- 2.2 cleaning


@query("cln_coerce_numeric", f"""
SELECT 'fuel' AS cell, total_fuel_t AS raw, {num('total_fuel_t')} AS parsed, count(*) AS cells FROM v_filings GROUP BY 1, 2
UNION ALL SELECT 'mass_work', fuel_per_work_mass_g_per_t_nmi, {num('fuel_per_work_mass_g_per_t_nmi')}, count(*) FROM v_filings GROUP BY 1, 2
UNION ALL SELECT 'distance', fuel_per_distance_kg_per_nmi, {num('fuel_per_distance_kg_per_nmi')}, count(*) FROM v_filings GROUP BY 1, 2""")
def _(t: Inputs):
    from bunkerline.functions.expr import as_number

    cells = F.explode(F.array(*[
        F.struct(F.lit(label).alias("cell"), F.col(c).alias("raw"))
        for label, c in (("fuel", "total_fuel_t"), ("mass_work", "fuel_per_work_mass_g_per_t_nmi"),
                         ("distance", "fuel_per_distance_kg_per_nmi"))
    ]))
    counted = t.filings.select(cells.alias("c")).groupBy("c.cell", "c.raw").agg(F.count(F.lit(1)).alias("cells"))
    return counted.select("cell", "raw", as_number("raw").alias("parsed"), "cells")


KIND = (
    "CASE WHEN text IS NULL OR lower(trim(text)) IN " + NULLS + " THEN 'null' WHEN lower(trim(text)) IN " + ERRORS
    + " THEN 'error' WHEN TRY_CAST(replace(trim(text), ',', '') AS DOUBLE) IS NULL THEN 'unparseable' ELSE 'number' END"
)


@query("cln_cell_kind_counts", f"""
SELECT source_file, col AS "column",
  count(*) FILTER (kind = 'number') AS number_cells, count(*) FILTER (kind = 'null') AS null_cells,
  count(*) FILTER (kind = 'error') AS error_cells, count(*) FILTER (kind = 'unparseable') AS unparseable_cells,
  COALESCE(min(text) FILTER (kind = 'unparseable'), '') AS examples
FROM (SELECT *, {KIND} AS kind FROM (
  {' UNION ALL '.join(f"SELECT source_file, '{c}' AS col, {c} AS text FROM v_filings" for c in NUMERIC)}))
GROUP BY ALL""")
def _(t: Inputs):
    return src.cell_kind_counts(t.filings).withColumn(
        "examples", F.coalesce(F.array_join("examples", ";"), F.lit(""))
    )


@query("cln_drop_blank", """
SELECT source_file, count(*) AS rows_read, count(*) FILTER (imo IS NOT NULL AND total_fuel_t IS NOT NULL) AS kept,
       count(*) FILTER (imo IS NULL OR total_fuel_t IS NULL) AS dropped FROM o_clean GROUP BY source_file""")
def _(t: Inputs):
    counts = t.typed.groupBy("source_file").agg(F.count(F.lit(1)).alias("rows_read"), F.count_if(src.is_filled()).alias("kept"))
    return counts.select("*", (F.col("rows_read") - F.col("kept")).alias("dropped"))


@query("cln_imo_cast", """
SELECT imo % 10 AS last_digit, count(*) AS filings, min(imo) AS low, max(imo) AS high FROM o_clean GROUP BY 1""")
def _(t: Inputs):
    return t.typed.groupBy((F.col("imo") % 10).alias("last_digit")).agg(
        F.count(F.lit(1)).alias("filings"), F.min("imo").alias("low"), F.max("imo").alias("high")
    )


@query("cln_dedup", """
SELECT imo, reporting_period, file_order, total_fuel_t, total_co2_t, time_at_sea_h, fuel_per_distance_kg_per_nmi FROM o_panel""")
def _(t: Inputs):
    return t.panel.select(
        "imo", "reporting_period", "file_order", "total_fuel_t", "total_co2_t", "time_at_sea_h",
        "fuel_per_distance_kg_per_nmi",
    )


@query("flt_usable_target", """
SELECT imo, reporting_period, round(inferred_lhv_mj_per_kg * fuel_per_distance_kg_per_nmi, 6) + 0e0 AS target
FROM o_usable WHERE inferred_lhv_mj_per_kg * fuel_per_distance_kg_per_nmi > 0""")
def _(t: Inputs):
    return features.with_target(t.usable).where("target > 0").select("imo", "reporting_period", rnd("target", 6).alias("target"))


# --------------------------------------------------------------------------- 2.3 physics
KEY = ["imo", "reporting_period"]


@query("drv_distance_speed", """
SELECT imo, reporting_period, round(distance_nmi, 6) + 0e0 AS distance_nmi, round(mean_speed_kn, 8) + 0e0 AS mean_speed_kn FROM o_speed""")
def _(t: Inputs):
    out = derive.with_distance_speed(t.panel)
    return out.select(*KEY, rnd("distance_nmi", 6).alias("distance_nmi"), rnd("mean_speed_kn", 8).alias("mean_speed_kn"))


@query("drv_cargo", """
SELECT imo, reporting_period, round(cargo_carried_t, 6) + 0e0 AS cargo_carried_t, cargo_basis FROM o_derived""")
def _(t: Inputs):
    return derive.with_cargo(t.panel).select(*KEY, rnd("cargo_carried_t", 6).alias("cargo_carried_t"), "cargo_basis")


@query("drv_implied_cf", "SELECT imo, reporting_period, round(cf, 9) + 0e0 AS implied_cf_t_per_t FROM o_derived")
def _(t: Inputs):
    return t.derived.select(*KEY, rnd("implied_cf_t_per_t", 9).alias("implied_cf_t_per_t"))


@query("drv_blend_lhv", """
SELECT imo, reporting_period, round(inferred_lhv_mj_per_kg, 8) + 0e0 AS lhv, round(inferred_blend_fraction, 8) + 0e0 AS share FROM o_energy""")
def _(t: Inputs):
    return t.derived.select(*KEY, rnd("inferred_lhv_mj_per_kg", 8).alias("lhv"), rnd("inferred_blend_fraction", 8).alias("share"))


@query("drv_energy_power", """
SELECT imo, reporting_period, round(energy_mj, 3) + 0e0 AS energy_mj, round(mean_power_kw, 6) + 0e0 AS mean_power_kw,
       round(energy_per_nmi_mj, 6) + 0e0 AS energy_per_nmi_mj FROM o_energy""")
def _(t: Inputs):
    return t.derived.select(
        *KEY, rnd("energy_mj", 3).alias("energy_mj"), rnd("mean_power_kw", 6).alias("mean_power_kw"),
        rnd("energy_per_nmi_mj", 6).alias("energy_per_nmi_mj"),
    )


@query("drv_shares", """
SELECT imo, reporting_period,
  round(CASE WHEN total_co2_t > 0 THEN co2_at_berth_t / total_co2_t END, 9) + 0e0 AS berth_co2_share,
  round(CASE WHEN total_fuel_t > 0 THEN laden_fuel_t / total_fuel_t END, 9) + 0e0 AS laden_fuel_share,
  round(CASE WHEN time_at_sea_h > 0 THEN COALESCE(time_at_sea_ice_h, 0e0) / time_at_sea_h END, 9) + 0e0 AS ice_time_share
FROM o_panel""")
def _(t: Inputs):
    out = derive.with_shares(t.panel)
    return out.select(*KEY, *[rnd(c, 9).alias(c) for c in ("berth_co2_share", "laden_fuel_share", "ice_time_share")])


@query("drv_tech_efficiency", "SELECT imo, reporting_period, metric, design FROM o_derived")
def _(t: Inputs):
    return derive.with_certificate(t.panel).select(
        *KEY, F.col("technical_efficiency_metric").alias("metric"),
        F.col("technical_efficiency_gco2_per_t_nmi").alias("design"),
    )


@query("drv_flags", """
SELECT imo, reporting_period, f_cf AS flag_implied_cf_t_per_t_implausible, f_speed AS flag_mean_speed_kn_implausible,
  f_time AS flag_time_at_sea_h_implausible, f_fuel AS flag_total_fuel_t_implausible, f_power AS flag_mean_power_kw_implausible,
  f_cargo AS flag_cargo_carried_t_implausible, f_zero AS flag_zero_fuel_while_sailing, f_negative AS flag_negative_fuel,
  f_cf AS flag_co2_fuel_inconsistent FROM o_derived""")
def _(t: Inputs):
    return t.derived.select(*KEY, *derive.BOUND_FLAGS, *derive.EXTRA_FLAGS, derive.ALIAS_FLAG)


@query("drv_is_usable", "SELECT imo, reporting_period, is_usable FROM o_derived")
def _(t: Inputs):
    return t.derived.select(*KEY, "is_usable")


@query("drv_quality_report", """
SELECT 'total' AS section, 'rows' AS item, CAST(count(*) AS DOUBLE) AS n FROM o_derived
UNION ALL SELECT 'total', 'rows_usable', count(*) FILTER (is_usable) FROM o_derived
UNION ALL SELECT 'total', 'usable_fraction', round(count(*) FILTER (is_usable) / count(*), 4) FROM o_derived
UNION ALL SELECT 'total', 'no_distance_reported', count(*) FILTER (distance_nmi IS NULL) FROM o_derived
UNION ALL SELECT 'total', 'no_cargo_reported', count(*) FILTER (cargo_basis = 'none') FROM o_derived
UNION ALL SELECT * FROM (SELECT 'flag', f, CAST(count(*) AS DOUBLE) FROM (
  SELECT 'flag_implied_cf_t_per_t_implausible' AS f FROM o_derived WHERE f_cf
  UNION ALL SELECT 'flag_mean_speed_kn_implausible' FROM o_derived WHERE f_speed
  UNION ALL SELECT 'flag_time_at_sea_h_implausible' FROM o_derived WHERE f_time
  UNION ALL SELECT 'flag_total_fuel_t_implausible' FROM o_derived WHERE f_fuel
  UNION ALL SELECT 'flag_mean_power_kw_implausible' FROM o_derived WHERE f_power
  UNION ALL SELECT 'flag_cargo_carried_t_implausible' FROM o_derived WHERE f_cargo
  UNION ALL SELECT 'flag_zero_fuel_while_sailing' FROM o_derived WHERE f_zero
  UNION ALL SELECT 'flag_negative_fuel' FROM o_derived WHERE f_negative) GROUP BY f)""")
def _(t: Inputs):
    return derive.quality_report(t.derived)


@query("drv_power_identity", """
SELECT count(*) AS "rows", max(gap) < 1e-9 AS holds FROM (
  SELECT abs(mean_power_kw - inferred_lhv_mj_per_kg * fuel_per_distance_kg_per_nmi * mean_speed_kn / 3.6e0) / mean_power_kw AS gap FROM o_usable)""")
def _(t: Inputs):
    return derive.power_identity(t.derived.where("is_usable")).select("rows", (F.col("max_relative_gap") < 1e-9).alias("holds"))


@query("drv_cf_crosscheck", """
SELECT count(residual) AS n, round(quantile_cont(residual, 0.05), 9) + 0e0 AS p05, round(quantile_cont(residual, 0.5), 9) + 0e0 AS p50,
       round(quantile_cont(residual, 0.95), 9) + 0e0 AS p95 FROM (
  SELECT co2_per_distance_kg_per_nmi / (fuel_per_distance_kg_per_nmi * cf) - 1e0 AS residual
  FROM o_derived WHERE fuel_per_distance_kg_per_nmi * cf > 0)""")
def _(t: Inputs):
    from bunkerline.operators.stats import cf_crosscheck

    out = cf_crosscheck(t.stored)
    return out.select("n", *[rnd(c, 9).alias(c) for c in ("p05", "p50", "p95")])


# the minimum slice: usable ships, speed and lifecycle emissions by class and period
@query("flagship_class_period", """
SELECT vessel_class, reporting_period, count(*) AS ship_years, round(quantile_cont(mean_speed_kn, 0.5), 8) + 0e0 AS median_speed_kn,
  round(avg(energy_per_nmi_mj), 6) + 0e0 AS mean_energy_per_nmi_mj,
  round(sum(energy_mj * 0.45e0) * (1e0 / 0.45e0 * (14.4e0 / 1e6 + 3.206e0 / 42.7e0 / 1000e0 + 0.001171e0 / 1e6 * 29.8e0 + 0.004215e0 / 1e6 * 273e0)) / 1000e0, 3) + 0e0 AS mgo_ktco2e
FROM (SELECT u.*, COALESCE(a.vessel_class, 'other') AS vessel_class FROM o_usable u LEFT JOIN o_alias a ON a.label = lower(trim(u.ship_type)))
GROUP BY ALL""")
def flagship(t: Inputs):
    from bunkerline.operators.stats import class_period_summary

    out = class_period_summary(t.usable)
    return out.select(
        "vessel_class", "reporting_period", "ship_years", rnd("median_speed_kn", 8).alias("median_speed_kn"),
        rnd("mean_energy_per_nmi_mj", 6).alias("mean_energy_per_nmi_mj"), rnd("mgo_ktco2e", 3).alias("mgo_ktco2e"),
    )
