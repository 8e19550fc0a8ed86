"""Queries over units, vessel classes, lifecycle emissions, ports, tanks and policy."""

from __future__ import annotations

from pyspark.sql import functions as F

from bunkerline import dims
from bunkerline import reference as ref
from bunkerline.functions import units
from bunkerline.functions.expr import rnd
from bunkerline.operators import emissions, features, policy, ports, tank
from bunkerline.plans.registry import Inputs, cte, query, values_cte

values_cte("o_pilot", ref.PILOT_COLUMNS, ref.PILOTS)
_years = sorted(ref.GRID_FACTORS)
values_cte("o_gridseg", "y0 int, f0 double, y1 int, f1 double",
           [(a, ref.GRID_FACTORS[a], b, ref.GRID_FACTORS[b]) for a, b in zip(_years, _years[1:])])
cte("o_gridyear", """
SELECT CAST(y AS INTEGER) AS year, COALESCE(f0 + (y - y0) / CAST(y1 - y0 AS DOUBLE) * (f1 - f0),
         CASE WHEN y < 2023 THEN 0.716e0 ELSE 0.2e0 END) / (1e0 - 0.17e0) AS grid
FROM (SELECT unnest(range(2000, 2070)) AS y) LEFT JOIN o_gridseg ON y >= y0 AND y < y1""")
cte("o_emsin", """
SELECT a.activity_id, a.fuel, CASE WHEN a.fuel = 'electricity' THEN 'grid' ELSE a.pathway END AS pathway, a.engine, a.year, a.energy_mj, g.grid,
  f.is_carrier, f.efficiency, f.charge_efficiency, f.lhv, f.cf, f.n2o_g_mj, f.ch4_g_mj, f.nox_g_kg, f.sox_g_kg, f.pm_g_kg,
  f.conf_ttw, f.conf_efficiency, f.conf_non_co2, f.conf_slip,
  p.wtt, p.biogenic, p.conf_pathway, COALESCE(s.slip_pct, 0e0) / 100e0 AS slip, COALESCE(pi.pilot_fraction, 0e0) AS share,
  pf.efficiency AS pe, pf.lhv AS pl, pf.cf AS pc, pf.n2o_g_mj AS pn, pf.ch4_g_mj AS pm, pp.wtt AS pw,
  pf.nox_g_kg AS p_nox, pf.sox_g_kg AS p_sox, pf.pm_g_kg AS p_pm
FROM v_activity a JOIN o_fuel f ON f.fuel = a.fuel JOIN o_gridyear g ON g.year = a.year
LEFT JOIN o_pathway p ON p.fuel = a.fuel AND p.pathway = a.pathway
LEFT JOIN o_slip s ON s.fuel = a.fuel AND s.engine = COALESCE(a.engine, f.default_engine)
LEFT JOIN o_pilot pi ON pi.fuel = a.fuel LEFT JOIN o_fuel pf ON pf.fuel = pi.pilot_fuel
LEFT JOIN o_pathway pp ON pp.fuel = pi.pilot_fuel AND pp.pathway = pi.pilot_pathway""")
cte("o_emsgwp", """
SELECT *, input * (1e0 - share) / lhv / 1000e0 AS mass, input * (1e0 - share) AS main FROM (
  SELECT i.*, w.gwp_set, w.ch4_fossil AS gc, w.n2o AS gn, energy_mj / efficiency AS input FROM o_emsin i CROSS JOIN o_gwp w)""")
cte("o_emsall", """
SELECT *, co2_t + ch4_t + n2o_t + pilot_t AS ttw_t, wtt_t + (co2_t + ch4_t + n2o_t + pilot_t) AS total_t FROM (
  SELECT *,
    CASE WHEN is_carrier THEN input / 3600e0 / charge_efficiency * grid ELSE main * wtt / 1e6 END AS wtt_t,
    CASE WHEN is_carrier OR biogenic THEN 0e0 ELSE mass * cf END AS co2_t,
    CASE WHEN is_carrier THEN 0e0 WHEN slip > 0 THEN mass * slip * gc ELSE main * ch4_g_mj / 1e6 * gc END AS ch4_t,
    CASE WHEN is_carrier THEN 0e0 ELSE main * n2o_g_mj / 1e6 * gn END AS n2o_t,
    CASE WHEN share > 0 THEN energy_mj * share / pe * pw / 1e6 + energy_mj * share / pe / pl / 1000e0 * pc + energy_mj * share / pe * pm / 1e6 * gc + energy_mj * share / pe * pn / 1e6 * gn ELSE 0e0 END AS pilot_t
  FROM o_emsgwp)""")
cte("o_ems", "SELECT * FROM o_emsall WHERE gwp_set = 'ar6_gwp100'")

# --------------------------------------------------------------------------- units and classes
UNIT_SQL = """
SELECT x.*, d.factor, CASE WHEN lower(token) IN ('mt','ton','tons','t/d','tpd','cbm','kt') THEN 'ambiguous'
       WHEN d.factor IS NULL THEN 'unknown' ELSE 'ok' END AS unit_status
FROM (SELECT *, trim(replace(trim(trim(unit), '[]()'), '³', '^3')) AS token FROM v_unit) x
LEFT JOIN o_unitdim d ON d.dimension = x.dimension AND d.unit = x.token"""
cte("o_unit", UNIT_SQL)


@query("unit_to_canonical", """
SELECT l_orderkey, l_linenumber, l_partkey, value, unit, dimension, round(CASE WHEN unit_status = 'ok' THEN value * factor END, 9) + 0e0 AS canonical_value FROM o_unit""")
def _(t: Inputs):
    return units.to_canonical(t.view("v_unit")).select(
        "l_orderkey", "l_linenumber", "l_partkey", "value", "unit", "dimension", rnd("canonical_value", 9).alias("canonical_value"))


@query("unit_reject_ambiguous", "SELECT unit, dimension, unit_status, count(*) AS cells FROM o_unit GROUP BY ALL")
def _(t: Inputs):
    counted = t.view("v_unit").groupBy("unit", "dimension").agg(F.count(F.lit(1)).alias("cells"))
    return units.with_unit_status(counted).select("unit", "dimension", "unit_status", "cells")


@query("unit_from_header", """
SELECT header, header_dimension, token AS header_unit, CASE WHEN token IS NULL THEN 'missing'
   WHEN lower(token) IN ('mt','ton','tons','t/d','tpd','cbm','kt') THEN 'ambiguous' WHEN d.factor IS NULL THEN 'unknown' ELSE 'ok' END AS unit_status, cells
FROM (SELECT header, header_dimension, count(*) AS cells,
        replace(trim(nullif(regexp_extract(trim(header), '[(\\[]([^)\\]]+)[)\\]]\\s*$', 1), '')), '³', '^3') AS token FROM v_unit GROUP BY 1, 2) h
LEFT JOIN o_unitdim d ON d.dimension = header_dimension AND d.unit = token""")
def _(t: Inputs):
    counted = t.view("v_unit").groupBy("header", "header_dimension").agg(F.count(F.lit(1)).alias("cells"))
    return units.header_unit(counted).select("header", "header_dimension", "header_unit", "unit_status", "cells")


@query("unit_kn_ms", """
SELECT imo, reporting_period, round(mean_speed_kn / 1.9438444924406046e0, 9) + 0e0 AS speed_ms,
       round(mean_speed_kn / 1.9438444924406046e0 * 1.9438444924406046e0, 8) + 0e0 AS back_kn FROM o_speed WHERE mean_speed_kn IS NOT NULL""")
def _(t: Inputs):
    moving = t.derived.where(F.col("mean_speed_kn").isNotNull())
    ms = units.kn_to_ms(F.col("mean_speed_kn"))
    return moving.select("imo", "reporting_period", rnd(ms, 9).alias("speed_ms"), rnd(units.ms_to_kn(ms), 8).alias("back_kn"))


@query("cls_resolve", """
SELECT p.imo, p.reporting_period, COALESCE(a.vessel_class, 'other') AS vessel_class FROM o_panel p LEFT JOIN o_alias a ON a.label = lower(trim(p.ship_type))""")
def _(t: Inputs):
    return features.resolve_class(t.panel).select("imo", "reporting_period", "vessel_class")


@query("cls_unknown_report", """
SELECT ship_type, count(*) AS rows FROM v_filings WHERE lower(trim(ship_type)) NOT IN (SELECT label FROM o_alias) GROUP BY 1""")
def _(t: Inputs):
    return features.unknown_labels(t.filings)


# --------------------------------------------------------------------------- emissions


def demand(t: Inputs):
    """Activity with the grid factor of its year; electricity needs no pathway."""
    return t.view("v_activity").withColumn("grid_factor_t_per_mwh", ports.grid_factor(F.col("year")))


def computed(t: Inputs, **kwargs):
    return emissions.compute(demand(t), **kwargs)


@query("ems_input_energy", "SELECT activity_id, round(energy_mj / efficiency, 6) + 0e0 AS input_energy_mj FROM o_emsin")
def _(t: Inputs):
    table = t.dim("fuels").select("fuel", "efficiency")
    rows = t.view("v_activity").join(F.broadcast(table), "fuel")
    return rows.select("activity_id", rnd(emissions.input_energy(F.col("energy_mj"), F.col("efficiency")), 6).alias("input_energy_mj"))


@query("ems_energy_mass", """
SELECT activity_id, round(energy_mj / lhv / 1000e0, 9) + 0e0 AS mass_t, round(energy_mj / lhv / 1000e0 * 1000e0 * lhv, 5) + 0e0 AS back_mj FROM o_emsin WHERE NOT is_carrier""")
def _(t: Inputs):
    table = t.dim("fuels").where("not is_carrier").select("fuel", "lhv")
    rows = t.view("v_activity").join(F.broadcast(table), "fuel")
    mass = emissions.mass_t(F.col("energy_mj"), F.col("lhv"))
    return rows.select("activity_id", rnd(mass, 9).alias("mass_t"), rnd(emissions.energy_of_mass(mass, F.col("lhv")), 5).alias("back_mj"))


@query("ems_pathway_resolve", """
SELECT fuel, given, status, count(*) AS n FROM (
  SELECT a.fuel, COALESCE(a.given, '') AS given, CASE WHEN a.fuel = 'electricity' OR (a.given IS NULL AND c.n = 1) THEN 'ok'
     WHEN a.given IS NULL THEN 'pathway_needed' WHEN p.pathway IS NULL THEN 'unknown_pathway' ELSE 'ok' END AS status
  FROM (SELECT fuel, CASE line WHEN 1 THEN NULL WHEN 2 THEN 'purple' ELSE pathway END AS given FROM v_activity) a
  LEFT JOIN (SELECT fuel, count(*) AS n FROM o_pathway GROUP BY fuel) c ON c.fuel = a.fuel
  LEFT JOIN o_pathway p ON p.fuel = a.fuel AND p.pathway = a.given) GROUP BY ALL""")
def _(t: Inputs):
    given = F.when(F.col("line") == 1, F.lit(None)).when(F.col("line") == 2, "purple").otherwise(F.col("pathway"))
    rows = demand(t).withColumn("pathway", given).withColumn("given", F.coalesce("pathway", F.lit("")))
    out = emissions.compute(rows)
    return out.groupBy("fuel", "given", F.col("emission_status").alias("status")).agg(F.count(F.lit(1)).alias("n"))


def part(name: str, column: str, digits: int = 8):
    @query(name, f"SELECT activity_id, fuel, pathway, round({column}, {digits}) + 0e0 AS {column} FROM o_ems")
    def _(t: Inputs):
        return computed(t).select("activity_id", "fuel", "pathway", rnd(column, digits).alias(column))


part("ems_wtt", "wtt_t")
part("ems_ttw_co2", "co2_t")
part("ems_ttw_ch4", "ch4_t")
part("ems_ttw_n2o", "n2o_t")
part("ems_pilot", "pilot_t")


@query("ems_electricity", """
SELECT activity_id, year, round(energy_mj / 0.92e0 / 3600e0 / 0.9e0, 8) + 0e0 AS mwh, round(energy_mj / 0.92e0 / 3600e0 / 0.9e0 * grid, 8) + 0e0 AS total_t
FROM o_emsin WHERE fuel = 'electricity'""")
def _(t: Inputs):
    out = emissions.compute(demand(t).where("fuel = 'electricity'"), keep_factors=True)
    mwh = F.col("input_energy_mj") / 3600.0 / F.col("charge_efficiency")
    return out.select("activity_id", "year", rnd(mwh, 8).alias("mwh"), rnd("total_t", 8).alias("total_t"))


@query("ems_totals", """
SELECT activity_id, fuel, pathway, round(wtt_t, 7) + 0e0 AS well_to_tank, round(co2_t, 7) + 0e0 AS combustion_co2, round(ch4_t, 7) + 0e0 AS methane_slip,
  round(n2o_t, 7) + 0e0 AS n2o, round(pilot_t, 7) + 0e0 AS pilot_fuel, round(total_t, 7) + 0e0 AS total, round(ttw_t, 7) + 0e0 AS ttw_t,
  round(total_t * 1e6 / energy_mj, 6) + 0e0 AS intensity_g_mj FROM o_ems""")
def _(t: Inputs):
    out = computed(t)
    return out.select(
        "activity_id", "fuel", "pathway", *[rnd(c, 7).alias(n) for n, c in emissions.BREAKDOWN.items()],
        rnd("ttw_t", 7).alias("ttw_t"), rnd("intensity_g_mj", 6).alias("intensity_g_mj"))


@query("ems_confidence", """
SELECT fuel, pathway, confidence, count(*) AS n FROM (SELECT fuel, pathway, CASE CASE WHEN is_carrier
    THEN greatest(COALESCE(rank_ttw, -1), COALESCE(rank_eff, -1))
    ELSE greatest(COALESCE(rank_path, -1), COALESCE(rank_ttw, -1), COALESCE(rank_non, -1), CASE WHEN slip > 0 THEN COALESCE(rank_slip, -1) ELSE -1 END) END
  WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'provisional' END AS confidence FROM (
  SELECT *, CASE conf_ttw WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'provisional' THEN 2 END AS rank_ttw,
    CASE conf_efficiency WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'provisional' THEN 2 END AS rank_eff,
    CASE conf_pathway WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'provisional' THEN 2 END AS rank_path,
    CASE conf_non_co2 WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'provisional' THEN 2 END AS rank_non,
    CASE conf_slip WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'provisional' THEN 2 END AS rank_slip FROM o_emsin)) GROUP BY ALL""")
def _(t: Inputs):
    return computed(t).groupBy("fuel", "pathway", "confidence").agg(F.count(F.lit(1)).alias("n"))


@query("ems_notes", """
SELECT activity_id, fuel, pathway, array_to_string(list_filter([
    CASE WHEN is_carrier THEN printf('grid at %.3f tCO2/MWh, %d%% drivetrain', grid, CAST(round(efficiency * 100) AS INTEGER)) END,
    CASE WHEN NOT is_carrier AND efficiency <> 1e0 THEN printf('%d%% conversion efficiency, ', CAST(round(efficiency * 100) AS INTEGER))
      || format('{:,.0f}', energy_mj / efficiency) || ' MJ in for ' || format('{:,.0f}', energy_mj) || ' MJ of shaft work' END,
    CASE WHEN NOT is_carrier AND biogenic THEN 'biogenic combustion CO2 left out; upstream burden counted' END,
    CASE WHEN NOT is_carrier AND slip > 0 THEN printf('methane slip %.2f%% of fuel mass (%s)', slip * 100, COALESCE(engine, 'measured fleet default')) END,
    CASE WHEN NOT is_carrier AND share > 0 THEN printf('%.1f%% of energy from pilot %s, counted in full', share * 100, pilot_fuel) END],
  lambda n: n IS NOT NULL), '; ') AS notes
FROM (SELECT i.*, p.pilot_fuel FROM o_emsin i LEFT JOIN o_pilot p ON p.fuel = i.fuel)""")
def _(t: Inputs):
    return computed(t, notes=True).select("activity_id", "fuel", "pathway", F.array_join("notes", "; ").alias("notes"))


@query("ems_local_pollutants", """
SELECT activity_id, fuel,
  round(CASE WHEN is_carrier THEN 0e0 ELSE energy_mj / efficiency * (1e0 - share) / lhv / 1000e0 * nox_g_kg + CASE WHEN share > 0 THEN energy_mj * share / pe / pl / 1000e0 * p_nox ELSE 0e0 END END, 7) + 0e0 AS nox_kg,
  round(CASE WHEN is_carrier THEN 0e0 ELSE energy_mj / efficiency * (1e0 - share) / lhv / 1000e0 * sox_g_kg + CASE WHEN share > 0 THEN energy_mj * share / pe / pl / 1000e0 * p_sox ELSE 0e0 END END, 7) + 0e0 AS sox_kg,
  round(CASE WHEN is_carrier THEN 0e0 ELSE energy_mj / efficiency * (1e0 - share) / lhv / 1000e0 * pm_g_kg + CASE WHEN share > 0 THEN energy_mj * share / pe / pl / 1000e0 * p_pm ELSE 0e0 END END, 7) + 0e0 AS pm_kg
FROM o_emsin""")
def _(t: Inputs):
    out = emissions.local_pollutants(t.view("v_activity"))
    return out.select("activity_id", "fuel", *[rnd(c, 7).alias(c) for c in ("nox_kg", "sox_kg", "pm_kg")])


@query("ems_gwp_switch", """
SELECT gwp_set, fuel, pathway, round(sum(ch4_t), 3) + 0e0 AS ch4_t, round(sum(n2o_t), 3) + 0e0 AS n2o_t, round(sum(total_t), 3) + 0e0 AS total_t FROM o_emsall GROUP BY ALL""")
def _(t: Inputs):
    sets = F.array(*[
        F.struct(F.lit(n).alias("gwp_set"), F.lit(c).alias("_gc"), F.lit(o).alias("_gn")) for n, _, c, _, o in ref.GWP_SETS])
    rows = demand(t).select("*", F.explode(sets).alias("_s")).select("*", "_s.*").drop("_s")
    out = emissions.compute(rows, gwp_columns=("_gc", "_gn"))
    return out.groupBy("gwp_set", "fuel", "pathway").agg(*[rnd(F.sum(c), 3).alias(c) for c in ("ch4_t", "n2o_t", "total_t")])


@query("ems_slip_range", """
SELECT a.fuel, count(*) AS n, round(min(r.p25) / 100e0, 9) + 0e0 AS slip_p25, round(min(r.p50) / 100e0, 9) + 0e0 AS slip_p50, round(min(r.p95) / 100e0, 9) + 0e0 AS slip_p95,
  round(sum(i.mass * r.p25 / 100e0), 4) + 0e0 AS ch4_low_t, round(sum(i.mass * r.p95 / 100e0), 4) + 0e0 AS ch4_high_t
FROM v_activity a JOIN o_ems i ON i.activity_id = a.activity_id LEFT JOIN o_sliprange r ON r.fuel = a.fuel GROUP BY a.fuel""")
def _(t: Inputs):
    ranges = t.dim("slip_ranges").drop("p75")
    rows = computed(t).join(F.broadcast(ranges), "fuel", "left")
    return rows.groupBy("fuel").agg(
        F.count(F.lit(1)).alias("n"), *[rnd(F.min(p) / 100.0, 9).alias(f"slip_{p}") for p in ("p25", "p50", "p95")],
        rnd(F.sum(F.col("fuel_mass_t") * F.col("p25") / 100.0), 4).alias("ch4_low_t"),
        rnd(F.sum(F.col("fuel_mass_t") * F.col("p95") / 100.0), 4).alias("ch4_high_t"))


OPTION_VALUES = ", ".join(
    f"('{f}', {'NULL' if p is None else repr(p)}, '{label}')" for f, p, label in ref.DEFAULT_OPTIONS)
cte("o_option", f"SELECT * FROM (VALUES {OPTION_VALUES}) v(fuel, pathway, label)")
cte("o_optmj", """
SELECT o.fuel, o.pathway, o.label, f.is_carrier, f.efficiency, f.lhv, f.cf, f.default_engine, p.wtt, p.biogenic, f.n2o_g_mj, f.ch4_g_mj,
  COALESCE(pi.pilot_fraction, 0e0) AS share,
  COALESCE(1e0 / pf.efficiency * (pp.wtt / 1e6 + pf.cf / pf.lhv / 1000e0 + pf.ch4_g_mj / 1e6 * 29.8e0 + pf.n2o_g_mj / 1e6 * 273e0), 0e0) AS pilot_mj
FROM o_option o JOIN o_fuel f ON f.fuel = o.fuel LEFT JOIN o_pathway p ON p.fuel = o.fuel AND p.pathway = o.pathway
LEFT JOIN o_pilot pi ON pi.fuel = o.fuel LEFT JOIN o_fuel pf ON pf.fuel = pi.pilot_fuel
LEFT JOIN o_pathway pp ON pp.fuel = pi.pilot_fuel AND pp.pathway = pi.pilot_pathway""")
cte("o_compare", """
SELECT b.call_id, b.energy_mj, o.fuel, COALESCE(o.pathway, 'grid') AS pathway, o.label,
  CASE WHEN o.is_carrier OR o.biogenic THEN 0e0 ELSE b.energy_mj / o.efficiency * (1e0 - o.share) / o.lhv / 1000e0 * o.cf END AS stack_t,
  CASE WHEN o.is_carrier THEN b.energy_mj / 0.92e0 / 3600e0 / 0.9e0 * g.grid ELSE
    b.energy_mj / o.efficiency * (1e0 - o.share) * (o.wtt / 1e6 + CASE WHEN o.biogenic THEN 0e0 ELSE o.cf / o.lhv / 1000e0 END
      + CASE WHEN o.fuel = 'lng' THEN 1.716e0 / 100e0 / o.lhv / 1000e0 * 29.8e0 ELSE o.ch4_g_mj / 1e6 * 29.8e0 END + o.n2o_g_mj / 1e6 * 273e0)
    + b.energy_mj * o.share * o.pilot_mj END AS total_t
FROM v_berth b CROSS JOIN o_optmj o JOIN o_gridyear g ON g.year = b.year""")


@query("ems_compare", """
SELECT call_id, fuel, pathway, label, CAST(row_number() OVER (PARTITION BY call_id ORDER BY total_t) AS INTEGER) AS place, round(total_t, 6) + 0e0 AS total_t FROM o_compare""")
def _(t: Inputs):
    rows = t.view("v_berth").select("call_id", "energy_mj", ports.grid_factor(F.col("year")).alias("grid_factor_t_per_mwh"))
    return emissions.compare(rows, ["call_id"]).select("call_id", "fuel", "pathway", "label", "place", rnd("total_t", 6).alias("total_t"))


MGO = "(1e0 / 0.45e0 * (14.4e0 / 1e6 + 3.206e0 / 42.7e0 / 1000e0 + 0.001171e0 / 1e6 * 29.8e0 + 0.004215e0 / 1e6 * 273e0))"


@query("ems_relative", f"SELECT activity_id, fuel, pathway, round(total_t / (energy_mj * {MGO}) - 1e0, 8) + 0e0 AS relative_change FROM o_ems")
def _(t: Inputs):
    return emissions.relative_to(demand(t)).select("activity_id", "fuel", "pathway", rnd("relative_change", 8).alias("relative_change"))


@query("ems_stack_vs_lifecycle", f"""
SELECT fuel, pathway, count(*) AS n, count(*) FILTER (stack < 0 AND life > 0) AS flips, round(avg(stack), 8) + 0e0 AS stack_change, round(avg(life), 8) + 0e0 AS lifecycle_change
FROM (SELECT fuel, pathway, CASE WHEN fuel = 'mgo' THEN 0e0 ELSE stack_t / (energy_mj / 0.45e0 / 42.7e0 / 1000e0 * 3.206e0) - 1e0 END AS stack,
        CASE WHEN fuel = 'mgo' THEN 0e0 ELSE total_t / (energy_mj * {MGO}) - 1e0 END AS life FROM o_compare) GROUP BY ALL""")
def _(t: Inputs):
    rows = t.view("v_berth").select("energy_mj", ports.grid_factor(F.col("year")).alias("grid_factor_t_per_mwh"))
    out = emissions.stack_versus_lifecycle(emissions.with_options(rows))
    return out.groupBy("fuel", "pathway").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("verdict_flips").alias("flips"),
        rnd(F.avg("stack_change"), 8).alias("stack_change"), rnd(F.avg("relative_change"), 8).alias("lifecycle_change"))


@query("ems_electrification_series", f"""
SELECT w.port, CAST(g.year AS INTEGER) AS year, round(w.energy / 0.92e0 / 3600e0 / 0.9e0 * g.grid, 3) + 0e0 AS electric_t, round(w.energy * {MGO}, 3) + 0e0 AS baseline_t,
  (SELECT CAST(min(c.year) AS INTEGER) FROM o_gridyear c WHERE c.year BETWEEN 2024 AND 2050 AND 1e0 / 0.92e0 / 3600e0 / 0.9e0 * c.grid < {MGO}) AS crossover_year,
  round(w.energy / 0.45e0 / 42.7e0 / 1000e0 * 57e0, 3) + 0e0 AS avoided_nox_kg, round(w.energy / 0.45e0 / 42.7e0 / 1000e0 * 2e0, 3) + 0e0 AS avoided_sox_kg,
  round(w.energy / 0.45e0 / 42.7e0 / 1000e0 * 0.3e0, 3) + 0e0 AS avoided_pm_kg
FROM (SELECT port, sum(energy_mj) AS energy FROM v_berth GROUP BY port) w CROSS JOIN o_gridyear g WHERE g.year BETWEEN 2024 AND 2047""")
def _(t: Inputs):
    out = ports.electrification_series(t.view("v_berth"), "port")
    return out.select(
        "port", "year", rnd("electric_t", 3).alias("electric_t"), rnd("baseline_t", 3).alias("baseline_t"), "crossover_year",
        *[rnd(f"avoided_{c}", 3).alias(f"avoided_{c}") for c in ("nox_kg", "sox_kg", "pm_kg")])


# --------------------------------------------------------------------------- ports
cte("o_availstep", "SELECT port, fuel, year AS y0, lead(year, 1, 9999) OVER (PARTITION BY port, fuel ORDER BY year) AS y1, status FROM o_avail")
cte("o_shorestep", "SELECT port, year AS y0, lead(year, 1, 9999) OVER (PARTITION BY port ORDER BY year) AS y1, status FROM o_shore")
cte("o_berthavail", """
SELECT b.*, COALESCE(s.status, 'none') AS availability, COALESCE(h.status, 'none') AS shore_status, g.grid FROM v_berth b
LEFT JOIN o_availstep s ON s.port = b.port AND s.fuel = b.fuel AND b.year >= s.y0 AND b.year < s.y1
LEFT JOIN o_shorestep h ON h.port = b.port AND b.year >= h.y0 AND b.year < h.y1 JOIN o_gridyear g ON g.year = b.year""")
cte("o_legport", """
SELECT l.leg_id, l.ports_text, l.fuel, l.year, p.port, p.pos, COALESCE(s.status, 'none') AS status FROM v_leg l,
  LATERAL (SELECT unnest(string_split(l.ports_text, '|')) AS port, unnest(range(1, len(string_split(l.ports_text, '|')) + 1)) AS pos) p
LEFT JOIN o_availstep s ON s.port = p.port AND s.fuel = l.fuel AND l.year >= s.y0 AND l.year < s.y1""")


@query("prt_availability", "SELECT call_id, port, fuel, year, availability FROM o_berthavail")
def _(t: Inputs):
    return ports.with_availability(t.view("v_berth")).select("call_id", "port", "fuel", "year", "availability")


@query("prt_can_bunker", "SELECT port, fuel, year, availability IN ('available', 'limited') AS can_bunker, count(*) AS calls FROM o_berthavail GROUP BY ALL")
def _(t: Inputs):
    calls = t.view("v_berth").groupBy("port", "fuel", "year").agg(F.count(F.lit(1)).alias("calls"))
    return ports.can_bunker(calls).select("port", "fuel", "year", "can_bunker", "calls")


def legs(t: Inputs):
    return t.view("v_leg").withColumn("ports", F.split("ports_text", r"\|"))


@query("prt_route_feasible", "SELECT leg_id, bool_and(status IN ('available', 'limited')) AS route_feasible FROM o_legport GROUP BY leg_id")
def _(t: Inputs):
    return ports.route_status(legs(t)).select("leg_id", "route_feasible")


@query("prt_blocking", """
SELECT leg_id, string_agg(port || ' (' || status || ')', ', ' ORDER BY pos) AS blocking FROM o_legport WHERE status NOT IN ('available', 'limited') GROUP BY leg_id""")
def _(t: Inputs):
    return ports.route_status(legs(t)).where("not route_feasible").select("leg_id", F.array_join("blocking_ports", ", ").alias("blocking"))


@query("prt_route_fuels", """
SELECT r.ports_text, r.year, r.legs, COALESCE(string_agg(f.fuel, ',' ORDER BY f.fuel), '') AS route_fuels FROM (
  SELECT ports_text, year, count(*) AS legs FROM v_leg GROUP BY ALL) r
LEFT JOIN (SELECT q.ports_text, q.year, q.fuel FROM (
   SELECT l.ports_text, l.year, f.fuel, bool_and(COALESCE(s.status, 'none') IN ('available', 'limited')) AS ok
   FROM (SELECT DISTINCT ports_text, year FROM v_leg) l CROSS JOIN (SELECT DISTINCT fuel FROM o_avail) f,
     LATERAL (SELECT unnest(string_split(l.ports_text, '|')) AS port) p
   LEFT JOIN o_availstep s ON s.port = p.port AND s.fuel = f.fuel AND l.year >= s.y0 AND l.year < s.y1 GROUP BY ALL) q WHERE q.ok) f
ON f.ports_text = r.ports_text AND f.year = r.year GROUP BY ALL""")
def _(t: Inputs):
    counted = legs(t).groupBy("ports_text", "year").agg(F.count(F.lit(1)).alias("legs"))
    rows = counted.withColumn("ports", F.split("ports_text", r"\|"))
    return ports.fuels_on_route(rows).select("ports_text", "year", "legs", F.array_join("route_fuels", ",").alias("route_fuels"))


@query("prt_earliest_year", """
SELECT b.port, b.fuel, b.calls, CAST(e.earliest AS INTEGER) AS earliest_year FROM (SELECT port, fuel, count(*) AS calls FROM v_berth GROUP BY ALL) b
LEFT JOIN (SELECT port, fuel, min(greatest(y0, 2024)) AS earliest FROM o_availstep WHERE status IN ('available', 'limited') AND y1 > 2024 AND y0 <= 2050 GROUP BY ALL) e
ON e.port = b.port AND e.fuel = b.fuel""")
def _(t: Inputs):
    calls = t.view("v_berth").groupBy("port", "fuel").agg(F.count(F.lit(1)).alias("calls"))
    return calls.join(F.broadcast(ports.earliest_years(t.spark)), ["port", "fuel"], "left").select("port", "fuel", "calls", "earliest_year")


@query("prt_filters", """
SELECT p.port, p.demo_site, p.hydrogen_hub, p.gttp, count(*) AS calls, count(*) FILTER (b.shore_status IN ('available', 'limited')) AS calls_with_shore_power,
       CAST(min(b.year) FILTER (b.shore_status IN ('available', 'limited')) AS INTEGER) AS first_ready_year_seen
FROM o_berthavail b JOIN o_port p ON p.port = b.port GROUP BY ALL""")
def _(t: Inputs):
    return ports.port_filters(t.view("v_berth"))


@query("prt_grid_factor", "SELECT b.year, round(g.grid, 9) + 0e0 AS delivered, round(g.grid * (1e0 - 0.17e0), 9) + 0e0 AS generated, count(*) AS calls FROM v_berth b JOIN o_gridyear g ON g.year = b.year GROUP BY ALL")
def _(t: Inputs):
    calls = t.view("v_berth").groupBy("year").agg(F.count(F.lit(1)).alias("calls"))
    return calls.select("year", rnd(ports.grid_factor(F.col("year")), 9).alias("delivered"),
                        rnd(ports.grid_factor(F.col("year"), include_losses=False), 9).alias("generated"), "calls")


@query("prt_shore_status", "SELECT call_id, port, year, shore_status FROM o_berthavail")
def _(t: Inputs):
    return ports.with_shore_status(t.view("v_berth")).select("call_id", "port", "year", "shore_status")


@query("prt_shore_power", f"""
SELECT call_id, ok AS available, reason, round(aux, 7) + 0e0 AS auxiliary_t, round(CASE WHEN ok THEN grid_t ELSE 0e0 END, 7) + 0e0 AS grid_t,
  round(CASE WHEN ok THEN aux - grid_t ELSE 0e0 END, 7) + 0e0 AS saving_t, round(CASE WHEN ok AND aux > 0 THEN (aux - grid_t) / aux ELSE 0e0 END, 7) + 0e0 AS saving_fraction
FROM (SELECT *, ready AND vessel_equipped AS ok, energy_mj * {MGO} AS aux, energy_mj / 0.92e0 / 3600e0 / 0.9e0 * grid AS grid_t,
   CASE WHEN NOT ready AND NOT vessel_equipped THEN 'neither fitted: port status ''' || shore_status || ''', vessel not equipped'
        WHEN NOT ready THEN 'port status ''' || shore_status || ''', not operational' WHEN NOT vessel_equipped THEN 'vessel not equipped' ELSE 'both fitted' END AS reason
  FROM (SELECT *, shore_status IN ('available', 'limited') AS ready FROM o_berthavail))""")
def _(t: Inputs):
    out = ports.shore_power(t.view("v_berth"))
    return out.select("call_id", "available", "reason", *[rnd(c, 7).alias(c) for c in ("auxiliary_t", "grid_t", "saving_t", "saving_fraction")])


@query("prt_crossover", f"""
SELECT b.call_id, CAST(min(g.year) AS INTEGER) AS crossover_year FROM v_berth b LEFT JOIN o_gridyear g ON g.year BETWEEN 2024 AND 2050
  AND b.energy_mj / 0.92e0 / 3600e0 / 0.9e0 * g.grid < b.energy_mj * {MGO} GROUP BY b.call_id""")
def _(t: Inputs):
    return ports.crossover(t.view("v_berth")).select("call_id", "crossover_year")


@query("prt_matrix", """
SELECT b.port, b.fuel, b.calls, max(st) FILTER (y = 2024) AS status_2024, max(st) FILTER (y = 2030) AS status_2030, max(st) FILTER (y = 2040) AS status_2040, max(st) FILTER (y = 2047) AS status_2047
FROM (SELECT b.port, b.fuel, b.calls, y, COALESCE(s.status, 'none') AS st FROM (SELECT port, fuel, count(*) AS calls FROM v_berth GROUP BY ALL) b
  CROSS JOIN (VALUES (2024), (2030), (2040), (2047)) v(y) LEFT JOIN o_availstep s ON s.port = b.port AND s.fuel = b.fuel AND y >= s.y0 AND y < s.y1) b GROUP BY ALL""")
def _(t: Inputs):
    return ports.port_matrix(t.view("v_berth"))


# --------------------------------------------------------------------------- tank
cte("o_leg", """
SELECT l.*, f.lhv * f.density / 1000e0 / f.tank_factor AS dens, 42.7e0 * 890e0 / 1000e0 / 1e0 AS mgo_dens FROM v_leg l JOIN o_fuel f ON f.fuel = l.fuel""")
cte("o_tank", """
SELECT *, mode_m3 * 1000e0 * dens * 0.95e0 AS usable_mj, mode_m3 * 1000e0 * dens * 0.95e0 / energy_per_nmi_mj * (1e0 - 0.15e0) AS range_n FROM (
  SELECT *, CASE mode WHEN 'installed' THEN tank_volume_m3 WHEN 'newbuild' THEN need WHEN 'retrofit' THEN ref_need END AS mode_m3 FROM (
    SELECT *, route_nmi * energy_per_nmi_mj / (1e0 - 0.15e0) / (dens * 1000e0) / 0.95e0 AS need,
              route_nmi * energy_per_nmi_mj / (1e0 - 0.15e0) / (mgo_dens * 1000e0) / 0.95e0 AS ref_need FROM o_leg)
  CROSS JOIN (VALUES ('installed'), ('newbuild'), ('retrofit')) m(mode))""")


@query("tnk_usable_energy", "SELECT leg_id, fuel, round(tank_volume_m3 * 1000e0 * dens * 0.95e0, 3) + 0e0 AS usable_energy_mj FROM o_leg")
def _(t: Inputs):
    usable = tank.usable_energy(F.col("tank_volume_m3"), tank.density_of(F.col("fuel")))
    return t.view("v_leg").select("leg_id", "fuel", rnd(usable, 3).alias("usable_energy_mj"))


@query("tnk_range", "SELECT leg_id, fuel, round(tank_volume_m3 * 1000e0 * dens * 0.95e0 / energy_per_nmi_mj * (1e0 - 0.15e0), 6) + 0e0 AS range_nmi FROM o_leg")
def _(t: Inputs):
    reach = tank.range_nmi(F.col("tank_volume_m3"), F.col("energy_per_nmi_mj"), tank.density_of(F.col("fuel")))
    return t.view("v_leg").select("leg_id", "fuel", rnd(reach, 6).alias("range_nmi"))


@query("tnk_required_volume", """
SELECT leg_id, fuel, round(route_nmi * energy_per_nmi_mj / (1e0 - 0.15e0) / (dens * 1000e0) / 0.95e0, 6) + 0e0 AS required_m3,
       round(route_nmi * energy_per_nmi_mj / dens / 1000e0, 6) + 0e0 AS plain_m3 FROM o_leg""")
def _(t: Inputs):
    density = tank.density_of(F.col("fuel"))
    return t.view("v_leg").select(
        "leg_id", "fuel", rnd(tank.required_volume(F.col("route_nmi"), F.col("energy_per_nmi_mj"), density), 6).alias("required_m3"),
        rnd(tank.plain_volume(F.col("route_nmi") * F.col("energy_per_nmi_mj"), density), 6).alias("plain_m3"))


@query("tnk_assess", """
SELECT leg_id, fuel, mode, round(mode_m3, 5) + 0e0 AS installed_m3, round(range_n, 5) + 0e0 AS range_nmi, range_n >= route_nmi * (1e0 - 1e-9) AS feasible,
  round(greatest(0e0, need - ref_need) * 0.8e0, 5) + 0e0 AS cargo_displaced_t, round(range_n / route_nmi, 7) + 0e0 AS range_margin FROM o_tank""")
def _(t: Inputs):
    rows = t.view("v_leg")
    modes = {
        "installed": tank.assess(rows, volume="tank_volume_m3"),
        "newbuild": tank.assess(rows, size_tank_for="fuel"),
        "retrofit": tank.assess(rows, size_tank_for="reference"),
    }
    out = None
    for mode, df in modes.items():
        df = df.select("leg_id", "fuel", F.lit(mode).alias("mode"), rnd("installed_m3", 5).alias("installed_m3"),
                       rnd("range_nmi", 5).alias("range_nmi"), "feasible", rnd("cargo_displaced_t", 5).alias("cargo_displaced_t"),
                       rnd("range_margin", 7).alias("range_margin"))
        out = df if out is None else out.unionByName(df)
    return out


# --------------------------------------------------------------------------- policy
REQUIRED = """CASE WHEN year <= 2023 THEN 0e0 WHEN year >= 2047 THEN 0.7e0 WHEN year <= 2030 THEN (year - 2023) / 7e0 * 0.3e0
  ELSE 0.3e0 + (year - 2030) / 17e0 * (0.7e0 - 0.3e0) END"""


@query("kpi_required_reduction", f"SELECT year, count(*) AS legs, round({REQUIRED}, 9) + 0e0 AS required_reduction FROM v_leg GROUP BY year")
def _(t: Inputs):
    rows = t.view("v_leg").groupBy("year").agg(F.count(F.lit(1)).alias("legs"))
    return rows.select("year", "legs", rnd(policy.required_reduction(F.col("year")), 9).alias("required_reduction"))


@query("kpi_assess", f"""
SELECT leg_id, year, round(cur, 8) + 0e0 AS current_intensity, round(ach, 8) + 0e0 AS achieved_reduction, round(req, 8) + 0e0 AS required_reduction, ach >= req - 1e-12 AS on_track,
  round(CASE WHEN req - ach < 1e-12 THEN 0e0 ELSE req - ach END, 8) + 0e0 AS gap, round(greatest(0e0, cur - baseline_intensity * (1e0 - req)), 8) + 0e0 AS headroom_intensity
FROM (SELECT *, emissions_t / cargo_t AS cur, 1e0 - emissions_t / cargo_t / baseline_intensity AS ach, {REQUIRED} AS req FROM v_leg)""")
def _(t: Inputs):
    out = policy.assess(t.view("v_leg").withColumn("baseline_intensity", F.col("baseline_intensity").cast("double")))
    return out.select("leg_id", "year", *[rnd(c, 8).alias(c) for c in ("current_intensity", "achieved_reduction", "required_reduction")],
                      "on_track", rnd("gap", 8).alias("gap"), rnd("headroom_intensity", 8).alias("headroom_intensity"))


@query("kpi_glide_path", f"""
SELECT ports_text, CAST(year AS INTEGER) AS year, round(base * (1e0 - {REQUIRED}), 7) + 0e0 AS required_intensity FROM (
  SELECT ports_text, avg(CAST(baseline_intensity AS DOUBLE)) AS base FROM v_leg GROUP BY ports_text) CROSS JOIN (SELECT unnest(range(2023, 2048)) AS year)""")
def _(t: Inputs):
    lanes = t.view("v_leg").groupBy("ports_text").agg(F.avg(F.col("baseline_intensity").cast("double")).alias("baseline_intensity"))
    return policy.glide_path(lanes, "ports_text", 2023, 2047).select("ports_text", "year", rnd("required_intensity", 7).alias("required_intensity"))


@query("kpi_carbon_cost", "SELECT leg_id, round(emissions_t * 2000e0, 3) + 0e0 AS carbon_cost_inr FROM v_leg")
def _(t: Inputs):
    return t.view("v_leg").select("leg_id", rnd(policy.carbon_cost(F.col("emissions_t"), F.lit(2000.0)), 3).alias("carbon_cost_inr"))
