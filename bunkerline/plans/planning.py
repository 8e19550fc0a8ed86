"""Queries over fleet plans and Pareto fronts."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bunkerline.functions.expr import md5_uniform, rnd
from bunkerline.operators import fleet, pareto, policy, scoring
from bunkerline.operators.fleet import COASTAL, TINY
from bunkerline.plans.registry import Inputs, cte, query, values_cte

OBJ = ["energy", "emissions", "cost"]


def vessels(t: Inputs) -> DataFrame:
    return t.view("v_vessel").withColumns({
        "compatible_routes": F.split("compatible_routes_text", r"\|"),
        "compatible_fuels": F.split("compatible_fuels_text", r"\|"),
    }).drop("compatible_routes_text", "compatible_fuels_text")


def assignments(t: Inputs) -> DataFrame:
    return t.view("v_plan").drop("vessel").join(vessels(t), "vessel_key")


def by_plan(t: Inputs) -> DataFrame:
    """The assignments dealt out by plan before they are scored: a plan's scores are added up where its vessels are."""
    return assignments(t).repartition("plan_id")


# --------------------------------------------------------------------------- oracle tables
values_cte("o_route", "route_idx int, route string, nmi double, demand double, max_hours double, p1 string, p2 string", [
    (0, "Mumbai-Cochin", 560.0, 900000.0, None, "mumbai", "cochin"),
    (1, "Mumbai-Mormugao", 230.0, 600000.0, None, "mumbai", "mormugao"),
    (2, "Cochin-Thoothukudi", 320.0, 450000.0, None, "cochin", "vo_chidambaranar"),
])
values_cte("o_ffuel", "fuel_idx int, fuel string, pathway string, price double", [
    (0, "mgo", "fossil", 1500.0), (1, "hfo", "fossil", 1100.0), (2, "lng", "fossil", 1300.0), (3, "methanol", "fossil", 2600.0)])
def fuel_sql(fuels: str) -> str:
    """Price, density and emissions of a scenario's fuels by their place in it."""
    return f"""
SELECT x.fuel_idx, x.fuel, x.price, f.efficiency, f.lhv * f.density / 1000e0 / f.tank_factor AS dens,
  (1e0 - COALESCE(pi.pilot_fraction, 0e0)) / f.efficiency * p.wtt / 1e6 + (1e0 - COALESCE(pi.pilot_fraction, 0e0)) / f.efficiency / f.lhv / 1000e0 * f.cf
  + CASE WHEN x.fuel = 'lng' THEN (1e0 / f.efficiency / f.lhv / 1000e0) * 0.01716e0 * 29.8e0 ELSE (1e0 - COALESCE(pi.pilot_fraction, 0e0)) / f.efficiency * f.ch4_g_mj / 1e6 * 29.8e0 END
  + (1e0 - COALESCE(pi.pilot_fraction, 0e0)) / f.efficiency * f.n2o_g_mj / 1e6 * 273e0
  + CASE WHEN x.fuel = 'methanol' THEN 0.04e0 * (1e0 / 0.45e0 * (14.4e0 / 1e6 + 3.206e0 / 42.7e0 / 1000e0 + 0.001171e0 / 1e6 * 29.8e0 + 0.004215e0 / 1e6 * 273e0)) ELSE 0e0 END AS t_per_mj
FROM {fuels} x JOIN o_fuel f ON f.fuel = x.fuel JOIN o_pathway p ON p.fuel = x.fuel AND p.pathway = x.pathway LEFT JOIN o_pilot pi ON pi.fuel = x.fuel"""


def route_fuel_sql(fuels: str) -> str:
    """Whether a fuel can be had in 2030 at both ends of a route."""
    return f"""
SELECT r.route_idx, f.fuel_idx, COALESCE(a.status, 'none') IN ('available', 'limited') AND COALESCE(b.status, 'none') IN ('available', 'limited') AS ok
FROM o_route r CROSS JOIN {fuels} f LEFT JOIN o_availstep a ON a.port = r.p1 AND a.fuel = f.fuel AND a.y0 <= 2030 AND 2030 < a.y1
LEFT JOIN o_availstep b ON b.port = r.p2 AND b.fuel = f.fuel AND b.y0 <= 2030 AND 2030 < b.y1"""


cte("o_fuelmj", fuel_sql("o_ffuel"))
cte("o_rfok", route_fuel_sql("o_ffuel"))


def scored_sql(source: str, keys: str, route: str = "o_route", transit: str = "r.max_hours", fuels: str = "o_fuelmj", usable: str = "o_rfok") -> str:
    """Scoring of (vessel row, route_idx, fuel_idx, speed_kn) rows as SQL."""
    return f"""
SELECT *, CASE WHEN failure = 'range' THEN (nmi - range_n) / nmi WHEN failure = 'schedule' THEN late WHEN failure IS NOT NULL THEN 1e0 ELSE 0e0 END AS failure_violation,
  CASE WHEN failure IS NULL THEN trips0 * greatest(0e0, capacity_t - displaced) ELSE 0e0 END AS delivered_t,
  CASE WHEN failure IS NULL THEN trips0 * (2e0 * nmi) * e / efficiency ELSE 0e0 END AS fuel_energy_mj,
  CASE WHEN failure IS NULL THEN trips0 * (2e0 * nmi) * e * t_per_mj ELSE 0e0 END AS emissions_t,
  CASE WHEN failure IS NULL THEN trips0 * (2e0 * nmi) * e / efficiency / 1000e0 * price + annual_cost_inr + trips0 * (2e0 * nmi) * e * t_per_mj * carbon ELSE 0e0 END AS cost_inr
FROM (SELECT *, CASE WHEN compatible_routes_text IS NOT NULL AND NOT list_contains(string_split(compatible_routes_text, '|'), route) THEN 'route_compatibility'
     WHEN compatible_fuels_text IS NOT NULL AND NOT list_contains(string_split(compatible_fuels_text, '|'), fuel) THEN 'fuel_compatibility'
     WHEN NOT ok THEN 'fuel_availability' WHEN range_n < nmi * (1e0 - 1e-9) THEN 'range' WHEN late > 0 THEN 'schedule' WHEN trips0 <= 0 THEN 'no_trips_possible' END AS failure
  FROM (SELECT *, tank_volume_m3 * 1000e0 * dens * 0.95e0 / e * (1e0 - 0.15e0) AS range_n,
      greatest(0e0, nmi * e / (1e0 - 0.15e0) / (dens * 1000e0) / 0.95e0 - nmi * e / (1e0 - 0.15e0) / (42.7e0 * 890e0 / 1000e0 * 1000e0) / 0.95e0) * 0.8e0 AS displaced,
      nmi / sailed - max_h AS late, round((available_hours - available_hours % (2e0 * nmi / sailed)) / (2e0 * nmi / sailed)) AS trips0
    FROM (SELECT *, 2500e0 * (capacity_t / 20000e0) * pow(sailed / 14e0, 2e0) AS e FROM (
      SELECT {keys}, v.*, s.speed_kn, r.route_idx, r.route, r.nmi, r.demand, {transit} AS max_h, f.fuel_idx, f.fuel, f.price, f.efficiency, f.dens, f.t_per_mj, k.ok, 2000e0 AS carbon,
        least(greatest(s.speed_kn, v.min_speed_kn), v.max_speed_kn) AS sailed,
        CASE WHEN abs(s.speed_kn - least(greatest(s.speed_kn, v.min_speed_kn), v.max_speed_kn)) > 1e-9 THEN abs(s.speed_kn - least(greatest(s.speed_kn, v.min_speed_kn), v.max_speed_kn)) ELSE 0e0 END AS speed_violation
      FROM {source} s JOIN v_vessel v ON v.vessel_key = s.vessel_key JOIN {route} r ON r.route_idx = s.route_idx JOIN {fuels} f ON f.fuel_idx = s.fuel_idx
      JOIN {usable} k ON k.route_idx = s.route_idx AND k.fuel_idx = s.fuel_idx))))"""


cte("o_assign", scored_sql("v_plan", "s.plan_id", transit="CASE r.route_idx WHEN 0 THEN 65e0 END"))
TIMED = replace(COASTAL, routes=(replace(COASTAL.routes[0], max_transit_hours=65.0), *COASTAL.routes[1:]))
def plan_sql(scored: str) -> str:
    """Objectives and violations of whole plans from their scored vessels."""
    return f"""
SELECT p.*, p.base + COALESCE(q.demand_violation, 0e0) AS violation, q.cargo_t FROM (
  SELECT plan_id, count(*) AS deployed, sum(fuel_energy_mj) AS energy_mj, sum(emissions_t) AS emissions_t, sum(cost_inr) AS cost_inr,
         sum(speed_violation) + sum(failure_violation) AS base FROM {scored} GROUP BY plan_id) p
JOIN (SELECT d.plan_id, sum(CASE WHEN r.demand - COALESCE(g.got, 0e0) > 1e-9 THEN (r.demand - COALESCE(g.got, 0e0)) / greatest(r.demand, 1e0) ELSE 0e0 END) AS demand_violation, sum(COALESCE(g.got, 0e0)) AS cargo_t
  FROM (SELECT DISTINCT plan_id FROM {scored}) d CROSS JOIN o_route r LEFT JOIN (SELECT plan_id, route, sum(delivered_t) AS got FROM {scored} GROUP BY ALL) g ON g.plan_id = d.plan_id AND g.route = r.route GROUP BY d.plan_id) q ON q.plan_id = p.plan_id"""


cte("o_plan", plan_sql("o_assign"))


# --------------------------------------------------------------------------- fleet
@query("flt_score_assignment", """
SELECT plan_id, vessel, route, fuel, COALESCE(failure, 'ok') AS outcome, round(speed_violation + failure_violation, 8) + 0e0 AS violation, round(delivered_t, 4) + 0e0 AS delivered_t,
  round(fuel_energy_mj, 2) + 0e0 AS fuel_energy_mj, round(emissions_t, 5) + 0e0 AS emissions_t, round(cost_inr, 1) + 0e0 AS cost_inr FROM o_assign""")
def _(t: Inputs):
    out = fleet.score_assignments(assignments(t), [TIMED])
    return out.select(
        "plan_id", "vessel", "route", "fuel", F.coalesce("failure", F.lit("ok")).alias("outcome"),
        rnd(F.col("speed_violation") + F.col("failure_violation"), 8).alias("violation"), rnd("delivered_t", 4).alias("delivered_t"),
        rnd("fuel_energy_mj", 2).alias("fuel_energy_mj"), rnd("emissions_t", 5).alias("emissions_t"), rnd("cost_inr", 1).alias("cost_inr"))


def plans(t: Inputs) -> DataFrame:
    return fleet.score_plans(fleet.score_assignments(by_plan(t), [TIMED]), [TIMED])


@query("flt_score_plan", """
SELECT plan_id, deployed, round(energy_mj, 2) + 0e0 AS energy_mj, round(emissions_t, 5) + 0e0 AS emissions_t, round(cost_inr, 1) + 0e0 AS cost_inr,
  round(violation, 7) + 0e0 AS violation, round(cargo_t, 3) + 0e0 AS cargo_t, violation <= 1e-9 AS feasible FROM o_plan""")
def _(t: Inputs):
    return plans(t).select(
        "plan_id", "deployed", rnd("energy_mj", 2).alias("energy_mj"), rnd("emissions_t", 5).alias("emissions_t"), rnd("cost_inr", 1).alias("cost_inr"),
        rnd("violation", 7).alias("violation"), rnd("cargo_t", 3).alias("cargo_t"), "feasible")


def cost_a_tonne(batch):
    """Rupees a tonne delivered; a plan that delivers nothing has no score."""
    return batch["cost_inr"] / batch["cargo_t"].where(batch["cargo_t"] > 0)


@query("flt_objective", """
SELECT plan_id, round(CASE WHEN cargo_t > 0 THEN cost_inr / cargo_t END, 6) + 0e0 AS cost_a_tonne, CASE WHEN cargo_t > 0 THEN NULL ELSE 'not a number' END AS error FROM o_plan""")
def _(t: Inputs):
    scored = scoring.score(plans(t).select("plan_id", "cost_inr", "cargo_t"), cost_a_tonne)
    finite = F.when(F.col("score") < float("inf"), F.col("score"))
    return scored.select("plan_id", rnd(finite, 6).alias("cost_a_tonne"), F.col("score_error").alias("error"))


SWEEP = (
    TIMED,
    replace(TIMED, name="capped", emission_cap_tco2e=20000.0, carbon_price_inr_per_t=8000.0),
    replace(TIMED, name="cheap_lng", prices={"lng": 700.0}, fuels=("lng", "mgo")),
)


# two fuels: the four places of a plan's fuel number fall on them in turn
values_cte("o_cheapfuel", "fuel_idx int, fuel string, pathway string, price double", [
    (0, "lng", "fossil", 700.0), (1, "mgo", "fossil", 1500.0), (2, "lng", "fossil", 700.0), (3, "mgo", "fossil", 1500.0)])
cte("o_cheapmj", fuel_sql("o_cheapfuel"))
cte("o_cheapok", route_fuel_sql("o_cheapfuel"))
cte("o_cheapassign", scored_sql("v_plan", "s.plan_id", transit="CASE r.route_idx WHEN 0 THEN 65e0 END", fuels="o_cheapmj", usable="o_cheapok"))
cte("o_cheapplan", plan_sql("o_cheapassign"))


@query("flt_scenario_sweep", """
SELECT scenario, count(*) AS n, round(sum(energy_mj) / 1e6, 2) + 0e0 AS energy_tj, round(sum(emissions_t), 2) + 0e0 AS emissions_t, round(sum(cost_inr) / 1e6, 2) + 0e0 AS cost_minr, round(sum(violation), 4) + 0e0 AS violation FROM (
  SELECT 'coastal' AS scenario, plan_id, energy_mj, emissions_t, cost_inr, violation FROM o_plan
  UNION ALL SELECT 'capped', plan_id, energy_mj, emissions_t, cost_inr + 6000e0 * emissions_t,
     violation + CASE WHEN emissions_t - 20000e0 > 1e-9 THEN (emissions_t - 20000e0) / 20000e0 ELSE 0e0 END FROM o_plan
  UNION ALL SELECT 'cheap_lng', plan_id, energy_mj, emissions_t, cost_inr, violation FROM o_cheapplan) GROUP BY scenario""")
def _(t: Inputs):
    scored = fleet.score_plans(fleet.score_assignments(by_plan(t), SWEEP), SWEEP)
    return scored.groupBy("scenario").agg(
        F.count(F.lit(1)).alias("n"), rnd(F.sum("energy_mj") / 1e6, 2).alias("energy_tj"), rnd(F.sum("emissions_t"), 2).alias("emissions_t"),
        rnd(F.sum("cost_inr") / 1e6, 2).alias("cost_minr"), rnd(F.sum("violation"), 4).alias("violation"))


@query("flt_scenario_prices", """
SELECT scenario, count(*) AS n, round(sum(cost_inr), 0) + 0e0 AS cost_inr, count(*) FILTER (violation <= 1e-9) AS feasible FROM (
  SELECT 'coastal' AS scenario, cost_inr, violation FROM o_plan
  UNION ALL SELECT 'capped', cost_inr + 6000e0 * emissions_t, violation + greatest(0e0, emissions_t - 20000e0) FROM o_plan
  UNION ALL SELECT 'cheap_lng', cost_inr, violation FROM o_cheapplan) GROUP BY scenario""")
def _(t: Inputs):
    scored = fleet.score_plans(fleet.score_assignments(by_plan(t), SWEEP), SWEEP)
    return scored.groupBy("scenario").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("cost_inr"), 0).alias("cost_inr"), F.count_if("feasible").alias("feasible"))


@query("flt_default_pathways", """
SELECT a.fuel, a.activities, CASE WHEN p.n = 1 THEN p.only_one WHEN p.has_fossil THEN 'fossil' WHEN p.has_grey THEN 'grey' END AS pathway FROM (
  SELECT fuel, count(*) AS activities FROM v_activity GROUP BY fuel) a
JOIN (SELECT fuel, count(*) AS n, min(pathway) AS only_one, bool_or(pathway = 'fossil') AS has_fossil, bool_or(pathway = 'grey') AS has_grey FROM o_pathway GROUP BY fuel) p ON p.fuel = a.fuel""")
def _(t: Inputs):
    from bunkerline.functions.expr import case_map

    chosen = fleet.default_pathways(["hfo", "mgo", "lng", "methanol", "ammonia", "hydrogen"])
    counted = t.view("v_activity").where(F.col("fuel").isin(list(chosen))).groupBy("fuel").agg(F.count(F.lit(1)).alias("activities"))
    return counted.withColumn("pathway", case_map(F.col("fuel"), chosen))


@query("flt_validate", """
SELECT rule, count(*) AS vessels FROM (SELECT 'speed_bounds' AS rule FROM o_odd WHERE max_speed_kn <= min_speed_kn OR min_speed_kn <= 0
  UNION ALL SELECT 'capacity' FROM o_odd WHERE capacity_t <= 0) GROUP BY rule""")
def _(t: Inputs):
    odd = t.view("v_vessel").withColumns({
        "max_speed_kn": F.when(F.col("max_speed_kn") == 17, F.lit(8.0)).otherwise(F.col("max_speed_kn")),
        "capacity_t": F.col("capacity_t") - 6400.0})
    return fleet.validate_vessels(odd).groupBy("rule").agg(F.count(F.lit(1)).alias("vessels"))


cte("o_odd", "SELECT min_speed_kn, CASE WHEN max_speed_kn = 17 THEN 8e0 ELSE max_speed_kn END AS max_speed_kn, capacity_t - 6400e0 AS capacity_t FROM v_vessel")


@query("flt_vessel_features", """
SELECT vessel, vessel_class, design_efficiency_gco2_per_t_nmi, CAST(design_efficiency_gco2_per_t_nmi IS NOT NULL AS INTEGER) AS has_design_efficiency, 1 AS efficiency_metric_eiv, 0 AS efficiency_metric_eedi,
  0 AS efficiency_metric_eexi, 0 AS has_ice_class, 0e0 AS ice_class_ordinal, 0e0 AS ice_time_share, 2030e0 AS reporting_period, available_hours AS time_at_sea_h FROM v_vessel""")
def _(t: Inputs):
    return fleet.vessel_features(t.view("v_vessel"), 2030)


def fleet_draw(kind: str, tag: str) -> str:
    return f"(CAST('0x' || substr(md5('{kind}-' || CAST(p_partkey AS VARCHAR) || '-{tag}'), 1, 8) AS BIGINT) / 4294967296e0)"


@query("flt_scenarios", f"""
SELECT 'large' AS kind, p_partkey AS vessel_key, 'V' || CAST(p_partkey AS VARCHAR) AS vessel, CASE WHEN p_partkey % 3 = 0 THEN 'general_cargo' ELSE 'bulk_carrier' END AS vessel_class,
  round(5000e0 + {fleet_draw('large', 'capacity')} * 35000e0, 6) + 0e0 AS capacity_t, round(13e0 + {fleet_draw('large', 'speed')} * 5e0, 6) + 0e0 AS max_speed_kn,
  round(600e0 + {fleet_draw('large', 'tank')} * 2400e0, 6) + 0e0 AS tank_volume_m3, round(6e7 + {fleet_draw('large', 'cost')} * (4e8 - 6e7), 2) + 0e0 AS annual_cost_inr FROM part
UNION ALL SELECT 'coastal', p_partkey, 'Coastal-' || CAST(p_partkey AS VARCHAR), CASE WHEN cap < 12000 THEN 'general_cargo' ELSE 'bulk_carrier' END, cap, spd, cap / 10, cap * 11000 FROM (
  SELECT p_partkey, [6000e0, 8000e0, 12000e0, 18000e0][CAST(floor({fleet_draw('coastal', 'capacity')} * 4) AS INTEGER) + 1] AS cap,
         [14e0, 15e0, 16e0][CAST(floor({fleet_draw('coastal', 'speed')} * 3) AS INTEGER) + 1] AS spd FROM part)
UNION ALL SELECT 'tug', p_partkey, 'Tug-' || CAST(p_partkey AS VARCHAR), 'harbour_tug', 80e0, 12e0, round(60e0 + {fleet_draw('tug', 'tank')} * 80e0, 6) + 0e0,
  round(2.2e7 + {fleet_draw('tug', 'cost')} * (3.2e7 - 2.2e7), 2) + 0e0 FROM part""")
def _(t: Inputs):
    parts = t.table("part").select(F.col("p_partkey").alias("index"))
    both = None
    for kind in ("large", "coastal", "tug"):
        df = fleet.generated_fleet(parts, kind).select(
            F.lit(kind).alias("kind"), "vessel_key", "vessel", "vessel_class", rnd("capacity_t", 6).alias("capacity_t"), rnd("max_speed_kn", 6).alias("max_speed_kn"),
            rnd("tank_volume_m3", 6).alias("tank_volume_m3"), rnd("annual_cost_inr", 2).alias("annual_cost_inr"))
        both = df if both is None else both.unionByName(df)
    return both


cte("o_cand", """
SELECT v.vessel_key, r.route_idx, f.fuel_idx, CAST(b AS INTEGER) AS band, v.min_speed_kn + b * ((v.max_speed_kn - v.min_speed_kn) / 4) AS speed_kn
FROM v_vessel v CROSS JOIN o_route r CROSS JOIN o_ffuel f CROSS JOIN (SELECT unnest(range(0, 5)) AS b)""")


@query("flt_candidates", "SELECT vessel_key, route_idx, fuel_idx, band, round(speed_kn, 9) + 0e0 AS speed_kn FROM o_cand")
def _(t: Inputs):
    out = fleet.candidates(vessels(t), COASTAL, 5)
    return out.select("vessel_key", "route_idx", "fuel_idx", "band", rnd("speed_kn", 9).alias("speed_kn"))


@query("flt_energy_intensity", """
SELECT vessel, round(2500e0 * (capacity_t / 20000e0) * pow(max_speed_kn / 14e0, 2e0), 6) + 0e0 AS fallback_mj_per_nmi,
  round(intensity * vr / 3.6e0 * ((1e0 - aux) * pow(max_speed_kn / vr, 3e0) + aux) * 3.6e0 / max_speed_kn, 6) + 0e0 AS curve_mj_per_nmi FROM o_vfeat""")
def _(t: Inputs):
    from bunkerline.operators import model
    from bunkerline.plans.panel import class_mean_scored

    _, levels = class_mean_scored(t)
    rows = fleet.vessel_features(t.view("v_vessel"), 2030, keep=["vessel", "capacity_t", "max_speed_kn"])
    curves = model.speed_curves(model.class_mean_intensity(rows, levels))
    speed = F.col("max_speed_kn")
    return curves.select("vessel", rnd(fleet.fallback_intensity(F.col("capacity_t"), speed), 6).alias("fallback_mj_per_nmi"),
                         rnd(fleet.energy_intensity(curves, speed), 6).alias("curve_mj_per_nmi"))


cte("o_best", """
SELECT r.route, r.demand, sum(CASE WHEN v.compatible_routes_text IS NULL OR list_contains(string_split(v.compatible_routes_text, '|'), r.route)
  THEN round((v.available_hours - v.available_hours % (2e0 * r.nmi / v.max_speed_kn)) / (2e0 * r.nmi / v.max_speed_kn)) * v.capacity_t ELSE 0e0 END) AS best FROM o_route r CROSS JOIN v_vessel v GROUP BY ALL""")


@query("flt_max_capacity", "SELECT route, demand AS demand_t, round(best, 2) + 0e0 AS best_t FROM o_best")
def _(t: Inputs):
    return fleet.max_capacity(vessels(t), COASTAL).select("route", "demand_t", rnd("best_t", 2).alias("best_t"))


HUNGRY = replace(COASTAL, routes=tuple(replace(r, annual_demand_t=r.annual_demand_t * 1e6) for r in COASTAL.routes[:2]) + COASTAL.routes[2:])


@query("flt_demand_check", "SELECT route, demand * 1e6 AS demand_t, round(demand * 1e6 - best, 2) + 0e0 AS short_t FROM o_best WHERE route <> 'Cochin-Thoothukudi' AND demand * 1e6 > best + 1e-9")
def _(t: Inputs):
    return fleet.demand_check(vessels(t), HUNGRY).select("route", "demand_t", rnd("short_t", 2).alias("short_t"))


@query("flt_search_space", "SELECT plan_id, count(*) AS fleet, round(pow(13e0, count(*)), 0) + 0e0 AS states FROM v_plan GROUP BY plan_id")
def _(t: Inputs):
    sizes = t.view("v_plan").groupBy("plan_id").agg(F.count(F.lit(1)).alias("fleet"))
    return sizes.withColumn("states", rnd(fleet.search_space(F.col("fleet"), COASTAL), 0))


@query("flt_encode_bits", """
SELECT plan_id, vessel_key, CASE WHEN vessel_key % 3 > 0 THEN '1' ELSE '0' END || CASE route_idx WHEN 0 THEN '00' WHEN 1 THEN '01' ELSE '10' END || CASE fuel_idx WHEN 0 THEN '00' WHEN 1 THEN '01' WHEN 2 THEN '10' ELSE '11' END AS bits FROM v_plan""")
def _(t: Inputs):
    rows = t.view("v_plan").withColumn("deploy", F.col("vessel_key") % 3 > 0)
    return fleet.encode_bits(rows, COASTAL).select("plan_id", "vessel_key", "bits")


cte("o_rawbits", """
SELECT p.plan_id, p.vessel_key, substr(md5('b-' || CAST(p.plan_id AS VARCHAR) || '-' || CAST(p.vessel_key AS VARCHAR)), 1, 5) AS h, p.speed_kn, v.min_speed_kn, v.max_speed_kn
FROM v_plan p JOIN v_vessel v ON v.vessel_key = p.vessel_key""")
cte("o_bits", """
SELECT *, CAST(substr(h, 1, 1) >= '8' AS INTEGER) AS b0, CAST(substr(h, 2, 1) >= '8' AS INTEGER) AS b1, CAST(substr(h, 3, 1) >= '8' AS INTEGER) AS b2,
  CAST(substr(h, 4, 1) >= '8' AS INTEGER) AS b3, CAST(substr(h, 5, 1) >= '8' AS INTEGER) AS b4 FROM o_rawbits""")


@query("flt_decode_bits", """
SELECT plan_id, vessel_key, b0 = 1 OR (max(b0) OVER (PARTITION BY plan_id) = 0 AND vessel_key = min(vessel_key) OVER (PARTITION BY plan_id)) AS deploy,
  (b1 * 2 + b2) % 3 AS route_idx, b3 * 2 + b4 AS fuel_idx, round(least(greatest(speed_kn, min_speed_kn), max_speed_kn), 9) + 0e0 AS speed_kn FROM o_bits""")
def _(t: Inputs):
    rows = assignments(t).select("plan_id", "vessel_key", "speed_kn", "min_speed_kn", "max_speed_kn")
    digest = F.md5(F.concat_ws("-", F.lit("b"), F.col("plan_id"), F.col("vessel_key")))
    bits = F.translate(F.substring(digest, 1, 5), "0123456789abcdef", "0000000011111111")
    out = fleet.decode_bits(rows.withColumn("bits", bits), COASTAL)
    return out.select("plan_id", "vessel_key", "deploy", "route_idx", "fuel_idx", rnd("decoded_speed_kn", 9).alias("speed_kn"))


def draw(tag: str) -> str:
    return f"(CAST('0x' || substr(md5('1000-' || CAST(plan_id AS VARCHAR) || '-' || CAST(vessel_key AS VARCHAR) || '-{tag}'), 1, 8) AS BIGINT) / 4294967296e0)"


@query("flt_random_plans", f"""
SELECT plan_id, vessel_key, on_ OR (NOT bool_or(on_) OVER (PARTITION BY plan_id) AND first_value(vessel_key) OVER (PARTITION BY plan_id ORDER BY pick, vessel_key) = vessel_key) AS deploy, route_idx, fuel_idx, round(speed_kn, 9) + 0e0 AS speed_kn
FROM (SELECT p.plan_id, p.vessel_key, {draw('deploy')} < 0.5e0 AS on_, {draw('pick')} AS pick, CAST(floor({draw('route')} * 3) AS INTEGER) AS route_idx, CAST(floor({draw('fuel')} * 4) AS INTEGER) AS fuel_idx,
   min_speed_kn + {draw('speed')} * (max_speed_kn - min_speed_kn) AS speed_kn FROM (SELECT a.plan_id, a.vessel_key, v.min_speed_kn, v.max_speed_kn FROM v_plan a JOIN v_vessel v ON v.vessel_key = a.vessel_key) p)""")
def _(t: Inputs):
    members = assignments(t).select("plan_id", "vessel_key", "min_speed_kn", "max_speed_kn")
    return fleet.random_plans(members, COASTAL).select("plan_id", "vessel_key", "deploy", "route_idx", "fuel_idx", rnd("speed_kn", 9).alias("speed_kn"))


@query("flt_real_decode", """
SELECT plan_id, vessel_key, xd > 0.5e0 OR (max(xd) OVER (PARTITION BY plan_id) <= 0.5e0 AND first_value(vessel_key) OVER (PARTITION BY plan_id ORDER BY xd DESC, vessel_key) = vessel_key) AS deploy,
  CAST(least(2, floor(xr * 3)) AS INTEGER) AS route_idx, CAST(least(3, floor(xf * 4)) AS INTEGER) AS fuel_idx, round(min_speed_kn + xs * (max_speed_kn - min_speed_kn), 9) + 0e0 AS speed_kn
FROM (SELECT p.plan_id, p.vessel_key, v.min_speed_kn, v.max_speed_kn, (p.speed_kn - 7.5e0) / 10e0 AS xd, p.route_idx / 2e0 AS xr, p.fuel_idx / 3e0 AS xf, 1e0 - (p.speed_kn - 7.5e0) / 10e0 AS xs FROM v_plan p JOIN v_vessel v ON v.vessel_key = p.vessel_key)""")
def _(t: Inputs):
    unit = (F.col("speed_kn") - 7.5) / 10.0
    rows = assignments(t).select(
        "plan_id", "vessel_key", "min_speed_kn", "max_speed_kn", unit.alias("x_deploy"), (F.col("route_idx") / 2.0).alias("x_route"),
        (F.col("fuel_idx") / 3.0).alias("x_fuel"), (1.0 - unit).alias("x_speed"))
    return fleet.real_decode(rows, COASTAL).select("plan_id", "vessel_key", "deploy", "route_idx", "fuel_idx", rnd("speed_kn", 9).alias("speed_kn"))


cte("o_bau", scored_sql("(SELECT plan_id, vessel_key, route_idx, 0 AS fuel_idx, speed_kn FROM v_plan)", "s.plan_id", transit="CASE r.route_idx WHEN 0 THEN 65e0 END"))
cte("o_bauplan", "SELECT plan_id, CASE WHEN sum(delivered_t) > 0 THEN sum(emissions_t) / sum(delivered_t) END AS bau FROM o_bau GROUP BY plan_id")


@query("flt_bau_intensity", "SELECT plan_id, round(bau, 9) + 0e0 AS bau_intensity FROM o_bauplan")
def _(t: Inputs):
    return fleet.bau_intensity(assignments(t), TIMED).select("plan_id", rnd("bau_intensity", 9).alias("bau_intensity"))


@query("flt_plan_report", """
SELECT p.plan_id, p.deployed, round(p.cargo_t, 3) + 0e0 AS cargo_t, m.fuel_mix, m.vessels, round(1e0 - p.emissions_t / p.cargo_t / b.bau, 7) + 0e0 AS achieved_reduction, 1e0 - p.emissions_t / p.cargo_t / b.bau >= 0.3e0 - 1e-12 AS on_track
FROM o_plan p JOIN o_bauplan b ON b.plan_id = p.plan_id JOIN (
  SELECT plan_id, string_agg(fuel || '=' || CAST(n AS VARCHAR), ',' ORDER BY fuel) AS fuel_mix, CAST(sum(n) AS BIGINT) AS vessels FROM (SELECT plan_id, fuel, count(*) AS n FROM o_assign GROUP BY ALL) GROUP BY plan_id) m ON m.plan_id = p.plan_id
WHERE p.cargo_t > 0 AND b.bau > 0""")
def _(t: Inputs):
    rows = assignments(t)
    scored = fleet.score_assignments(rows, [TIMED])
    report = fleet.plan_report(scored).select(
        "plan_id", F.array_join(F.transform(F.map_entries("fuel_mix"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("fuel_mix"),
        F.col("deployed").alias("vessels"))
    totals = fleet.score_plans(scored, [TIMED]).join(fleet.bau_intensity(rows, TIMED), "plan_id").where("cargo_t > 0 and bau_intensity > 0")
    status = policy.assess(totals.withColumns({"year": F.lit(2030), "baseline_intensity": F.col("bau_intensity")}))
    return status.join(report, "plan_id").select(
        "plan_id", "deployed", rnd("cargo_t", 3).alias("cargo_t"), "fuel_mix", "vessels", rnd("achieved_reduction", 7).alias("achieved_reduction"), "on_track")


@query("flt_greedy")
def _(t: Inputs):
    # every block of vessel keys is its own fleet
    fleets = vessels(t).withColumn("fleet", F.floor(F.col("vessel_key") / 200).cast("bigint"))
    chosen = fleet.greedy(fleets, COASTAL, "fleet")
    return chosen.groupBy("fleet", "fraction", "fuel_idx").agg(
        F.count(F.lit(1)).alias("deployed"), F.sum("delivered_t").alias("delivered_t"), F.sum("cost_inr").alias("cost_inr"), F.sum("emissions_t").alias("emissions_t"))


# small instances: two neighbouring vessels, one route
values_cte("o_troute", "route_idx int, route string, nmi double, demand double, max_hours double, p1 string, p2 string", [
    (0, "Mumbai-Cochin", 560.0, 250000.0, None, "mumbai", "cochin")])


def tiny_candidates(bands: int) -> str:
    return f"""(SELECT v.vessel_key, 0 AS route_idx, CAST(f AS INTEGER) AS fuel_idx, CAST(b AS INTEGER) AS band, v.min_speed_kn + b * ((v.max_speed_kn - v.min_speed_kn) / {bands - 1}) AS speed_kn
  FROM v_vessel v CROSS JOIN (SELECT unnest(range(0, 2)) AS f) CROSS JOIN (SELECT unnest(range(0, {bands})) AS b))"""


cte("o_tiny5", f"SELECT vessel_key, CAST(floor(vessel_key / 2) AS BIGINT) AS instance, fuel_energy_mj AS en, emissions_t AS em, cost_inr - emissions_t * 2000e0 AS co, delivered_t AS de FROM ({scored_sql(tiny_candidates(5), 's.band', 'o_troute')}) WHERE failure IS NULL")
cte("o_tinyall", """
SELECT instance, en, em, co FROM (
  SELECT a.instance, a.en + b.en AS en, a.em + b.em AS em, a.co + b.co AS co, a.de + b.de AS de FROM (SELECT instance, vessel_key, en, em, co, de FROM o_tiny5 UNION ALL SELECT DISTINCT CAST(floor(vessel_key / 2) AS BIGINT), vessel_key, 0e0, 0e0, 0e0, 0e0 FROM v_vessel) a
  JOIN (SELECT instance, vessel_key, en, em, co, de FROM o_tiny5 UNION ALL SELECT DISTINCT CAST(floor(vessel_key / 2) AS BIGINT), vessel_key, 0e0, 0e0, 0e0, 0e0 FROM v_vessel) b ON b.instance = a.instance AND b.vessel_key > a.vessel_key
  UNION ALL SELECT instance, en, em, co, de FROM o_tiny5 WHERE instance IN (SELECT CAST(floor(vessel_key / 2) AS BIGINT) FROM v_vessel GROUP BY 1 HAVING count(*) = 1)) WHERE de >= 250000e0 - 1e-9""")


@query("flt_exact_small", """
SELECT p.instance, CAST(count(*) AS INTEGER) AS feasible_plans, round(min(co), 1) + 0e0 AS min_cost_inr, round(min(em), 5) + 0e0 AS min_emissions_t,
  CAST(count(*) FILTER (NOT EXISTS (SELECT 1 FROM o_tinyall q WHERE q.instance = p.instance AND q.en <= p.en AND q.em <= p.em AND q.co <= p.co AND (q.en < p.en OR q.em < p.em OR q.co < p.co))) AS INTEGER) AS front_size
FROM o_tinyall p GROUP BY p.instance""")
def _(t: Inputs):
    paired = vessels(t).withColumn("instance", F.floor(F.col("vessel_key") / 2).cast("bigint"))
    out = fleet.exact_small(paired, TINY, "instance")
    return out.select("instance", "feasible_plans", rnd("min_cost_inr", 1).alias("min_cost_inr"), rnd("min_emissions_t", 5).alias("min_emissions_t"), "front_size")


cte("o_tiny3", f"SELECT vessel_key, CAST(floor(vessel_key / 2) AS BIGINT) AS instance, fuel_idx, band, cost_inr - emissions_t * 2000e0 AS co, delivered_t AS de FROM ({scored_sql(tiny_candidates(3), 's.band', 'o_troute')}) WHERE failure IS NULL")
cte("o_qvar", """
SELECT *, CAST(row_number() OVER (PARTITION BY instance ORDER BY vessel_key, fuel_idx, band) - 1 AS INTEGER) AS i, max(co) OVER (PARTITION BY instance) * 10e0 AS p,
  max(co) OVER (PARTITION BY instance) * 10e0 / greatest(pow(avg(CASE WHEN de > 0 THEN de END) OVER (PARTITION BY instance), 2), 1e0) AS s FROM o_tiny3""")
cte("o_qterm", """
SELECT instance, i, i AS j, co + s * (de * de - 2e0 * 250000e0 * de) AS q FROM o_qvar
UNION ALL SELECT a.instance, a.i, b.i, CASE WHEN a.vessel_key = b.vessel_key THEN a.p ELSE 0e0 END + 2e0 * a.s * a.de * b.de FROM o_qvar a JOIN o_qvar b ON b.instance = a.instance AND b.i > a.i
UNION ALL SELECT instance, -1, -1, max(s) * 250000e0 * 250000e0 FROM o_qvar GROUP BY instance""")


def qubo(t: Inputs) -> DataFrame:
    paired = vessels(t).withColumn("instance", F.floor(F.col("vessel_key") / 2).cast("bigint"))
    return fleet.qubo_variables(paired, TINY, "instance")


@query("flt_qubo_terms", "SELECT instance, i, j, round(q / 1e9, 7) + 0e0 AS q_bn FROM o_qterm")
def _(t: Inputs):
    return fleet.qubo_terms(qubo(t), TINY, "instance").select("instance", "i", "j", rnd(F.col("q") / 1e9, 7).alias("q_bn"))


@query("flt_qubo_energy", """
WITH_X
SELECT x.instance, x.sample, CAST(x.n AS INTEGER) AS chosen, round((COALESCE(e.q, 0e0) + o.q) / 1e9, 6) + 0e0 AS energy_bn FROM (SELECT instance, sample, sum(CAST(on_ AS INTEGER)) AS n FROM o_qx GROUP BY ALL) x
JOIN (SELECT instance, q FROM o_qterm WHERE i = -1) o ON o.instance = x.instance
LEFT JOIN (SELECT t.instance, a.sample, sum(t.q) AS q FROM o_qterm t JOIN o_qx a ON a.instance = t.instance AND a.i = t.i AND a.on_ JOIN o_qx b ON b.instance = t.instance AND b.i = t.j AND b.sample = a.sample AND b.on_ GROUP BY ALL) e
ON e.instance = x.instance AND e.sample = x.sample""".replace("WITH_X\n", ""))
def _(t: Inputs):
    out = fleet.qubo_energy(qubo(t), TINY, "instance", samples=3)
    return out.select("instance", "sample", "chosen", rnd(F.col("energy") / 1e9, 6).alias("energy_bn"))


cte("o_qx", """
SELECT instance, i, CAST(sample AS INTEGER) AS sample, CAST('0x' || substr(md5('1000-' || CAST(instance AS VARCHAR) || '-' || CAST(sample AS VARCHAR) || '-' || CAST(i AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296e0 < 0.4e0 AS on_
FROM o_qvar CROSS JOIN (SELECT unnest(range(0, 3)) AS sample)""")


# --------------------------------------------------------------------------- Pareto
cte("o_feas", "SELECT * FROM v_front WHERE violation <= 1e-9")
cte("o_sky", """
SELECT * FROM o_feas a WHERE NOT EXISTS (SELECT 1 FROM o_feas b WHERE b.energy <= a.energy AND b.emissions <= a.emissions AND b.cost <= a.cost
  AND (b.energy < a.energy OR b.emissions < a.emissions OR b.cost < a.cost))""")
cte("o_skyalg", """
SELECT * FROM o_feas a WHERE NOT EXISTS (SELECT 1 FROM o_feas b WHERE b.algorithm = a.algorithm AND b.energy <= a.energy AND b.emissions <= a.emissions AND b.cost <= a.cost
  AND (b.energy < a.energy OR b.emissions < a.emissions OR b.cost < a.cost))""")


def front(t: Inputs) -> DataFrame:
    return pareto.skyline(t.view("v_front"), OBJ, "violation")


@query("par_dominates", """
SELECT a.plan_id, a.energy <= b.energy AND a.emissions <= b.emissions AND a.cost <= b.cost AND (a.energy < b.energy OR a.emissions < b.emissions OR a.cost < b.cost) AS dominates_next
FROM v_front a JOIN v_front b ON b.plan_id = a.plan_id + 1""")
def _(t: Inputs):
    a = t.view("v_front")
    b = a.select((F.col("plan_id") - 1).alias("plan_id"), *[F.col(c).alias(f"next_{c}") for c in OBJ])
    return a.join(b, "plan_id").select("plan_id", pareto.dominates([F.col(c) for c in OBJ], [F.col(f"next_{c}") for c in OBJ]).alias("dominates_next"))


@query("par_skyline", "SELECT plan_id, energy, emissions, cost FROM o_sky")
def _(t: Inputs):
    return front(t).select("plan_id", *OBJ)


@query("par_constrained_rank", """
SELECT f.plan_id, CASE WHEN f.violation > 1e-9 THEN 2 WHEN s.plan_id IS NOT NULL THEN 0 ELSE 1 END AS tier, CASE WHEN f.violation > 1e-9 THEN rank() OVER (PARTITION BY f.violation > 1e-9 ORDER BY f.violation) END AS violation_rank
FROM v_front f LEFT JOIN o_sky s ON s.plan_id = f.plan_id""")
def _(t: Inputs):
    return pareto.constrained_rank(t.view("v_front"), OBJ, "violation", "plan_id").select("plan_id", "tier", "violation_rank")


cte("o_ref", """
SELECT max(energy) + 0.1e0 * CASE WHEN max(energy) > min(energy) THEN max(energy) - min(energy) ELSE abs(max(energy)) + 1 END AS rx,
  max(emissions) + 0.1e0 * CASE WHEN max(emissions) > min(emissions) THEN max(emissions) - min(emissions) ELSE abs(max(emissions)) + 1 END AS ry,
  max(cost) + 0.1e0 * CASE WHEN max(cost) > min(cost) THEN max(cost) - min(cost) ELSE abs(max(cost)) + 1 END AS rz FROM o_skyalg""")


def reference(t: Inputs) -> DataFrame:
    return pareto.reference_point(pareto.skyline(t.view("v_front"), OBJ, "violation", ["algorithm"]), OBJ)


@query("par_reference_point", "SELECT round(rx, 4) + 0e0 AS ref_energy, round(ry, 4) + 0e0 AS ref_emissions, round(rz, 4) + 0e0 AS ref_cost FROM o_ref")
def _(t: Inputs):
    return reference(t).select(*[rnd(f"ref_{c}", 4).alias(f"ref_{c}") for c in OBJ])


@query("par_hypervolume_2d", """
SELECT round(sum(CASE WHEN emissions < best THEN (500000e0 - energy) * (best - emissions) ELSE 0e0 END) / 1e9, 6) + 0e0 AS hypervolume_bn FROM (
  SELECT *, least(2000000e0, COALESCE(min(emissions) OVER (ORDER BY energy, emissions ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 2000000e0)) AS best FROM o_feas WHERE energy < 500000 AND emissions < 2000000)""")
def _(t: Inputs):
    rows = t.view("v_front").where("violation <= 1e-9")
    out = pareto.hypervolume_2d(rows, "energy", "emissions", (500000.0, 2000000.0))
    return out.select(rnd(F.col("hypervolume") / 1e9, 6).alias("hypervolume_bn"))


@query("par_hypervolume_3d", """
SELECT round(sum(area * thick) / 1e15, 6) + 0e0 AS hypervolume_e15 FROM (
  SELECT lvl, thick, sum(CASE WHEN emissions < best THEN (500000e0 - energy) * (best - emissions) ELSE 0e0 END) AS area FROM (
    SELECT l.lvl, l.thick, p.energy, p.emissions, least(2000000e0, COALESCE(min(p.emissions) OVER (PARTITION BY l.lvl ORDER BY p.energy, p.emissions ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 2000000e0)) AS best
    FROM (SELECT cost AS lvl, lead(cost, 1, 1000000e0) OVER (ORDER BY cost) - cost AS thick FROM (SELECT DISTINCT cost FROM o_sky WHERE energy < 500000 AND emissions < 2000000 AND cost < 1000000)) l
    JOIN o_sky p ON p.cost <= l.lvl AND p.energy < 500000 AND p.emissions < 2000000 AND p.cost < 1000000) GROUP BY lvl, thick)""")
def _(t: Inputs):
    out = pareto.hypervolume_3d(t.view("v_front").where("violation <= 1e-9"), OBJ, (500000.0, 2000000.0, 1000000.0))
    return out.select(rnd(F.col("hypervolume") / 1e15, 6).alias("hypervolume_e15"))


@query("par_igd", """
SELECT algorithm, round(avg(d), 4) + 0e0 AS igd FROM (SELECT r.algorithm, p.plan_id, min(sqrt((p.energy - r.energy) * (p.energy - r.energy) + (p.emissions - r.emissions) * (p.emissions - r.emissions) + (p.cost - r.cost) * (p.cost - r.cost))) AS d
  FROM o_sky p CROSS JOIN o_skyalg r GROUP BY ALL) GROUP BY algorithm""")
def _(t: Inputs):
    by_algorithm = pareto.skyline(t.view("v_front"), OBJ, "violation", ["algorithm"])
    return pareto.igd(by_algorithm, front(t), "plan_id", OBJ, "algorithm").select("algorithm", rnd("igd", 4).alias("igd"))


@query("par_spacing", """
SELECT round(stddev_pop(d), 5) + 0e0 AS spacing FROM (SELECT a.plan_id, min(sqrt((a.energy - b.energy) * (a.energy - b.energy) + (a.emissions - b.emissions) * (a.emissions - b.emissions) + (a.cost - b.cost) * (a.cost - b.cost))) AS d
  FROM o_feas a JOIN o_feas b ON a.plan_id <> b.plan_id GROUP BY a.plan_id)""")
def _(t: Inputs):
    rows = t.view("v_front").where("violation <= 1e-9")
    return pareto.spacing(rows, "plan_id", OBJ).select(rnd("spacing", 5).alias("spacing"))


def gap_sql(c: str) -> str:
    w = f"OVER (ORDER BY {c}, plan_id)"
    return f"CASE WHEN lag({c}) {w} IS NULL OR lead({c}) {w} IS NULL THEN 'inf'::DOUBLE ELSE (lead({c}) {w} - lag({c}) {w}) / (max({c}) OVER () - min({c}) OVER ()) END"


cte("o_crowd", f"SELECT *, {' + '.join(gap_sql(c) for c in OBJ)} AS crowding FROM o_feas")


@query("par_crowding", "SELECT plan_id, round(CASE WHEN isinf(crowding) THEN -1e0 ELSE crowding END, 8) + 0e0 AS crowding FROM o_crowd")
def _(t: Inputs):
    out = pareto.crowding(t.view("v_front").where("violation <= 1e-9"), OBJ, "plan_id")
    finite = F.when(F.col("crowding") == float("inf"), -1.0).otherwise(F.col("crowding"))
    return out.select("plan_id", rnd(finite, 8).alias("crowding"))


@query("par_thin", "SELECT plan_id FROM o_crowd ORDER BY crowding DESC, plan_id LIMIT 60")
def _(t: Inputs):
    return pareto.thin(t.view("v_front").where("violation <= 1e-9"), OBJ, "plan_id", 60).select("plan_id")


@query("par_sort_by_cost", "SELECT plan_id, cost, row_number() OVER (ORDER BY cost, plan_id) - 1 AS place FROM o_feas")
def _(t: Inputs):
    return pareto.sort_by(t.view("v_front").where("violation <= 1e-9"), "cost", "plan_id").select("plan_id", "cost", "place")


@query("par_best_by", """
SELECT (SELECT plan_id FROM o_sky ORDER BY energy, plan_id LIMIT 1) AS best_energy, (SELECT plan_id FROM o_sky ORDER BY emissions, plan_id LIMIT 1) AS best_emissions, (SELECT plan_id FROM o_sky ORDER BY cost, plan_id LIMIT 1) AS best_cost""")
def _(t: Inputs):
    return pareto.best_by(front(t), OBJ, "plan_id")


@query("par_archive_update", """
SELECT a.plan_id, a.energy, a.emissions, a.cost, CAST(a.violation AS DOUBLE) AS violation FROM o_sky a WHERE NOT EXISTS (
  SELECT 1 FROM o_sky b WHERE b.plan_id < a.plan_id AND abs(a.energy - b.energy) <= 1e-5 * greatest(abs(a.energy), abs(b.energy))
    AND abs(a.emissions - b.emissions) <= 1e-5 * greatest(abs(a.emissions), abs(b.emissions)) AND abs(a.cost - b.cost) <= 1e-5 * greatest(abs(a.cost), abs(b.cost)))""")
def _(t: Inputs):
    rows = t.view("v_front").select("plan_id", *OBJ, F.col("violation").cast("double").alias("violation"))
    held = pareto.update_archive(None, rows.where("plan_id % 2 = 0"), OBJ, "plan_id", violation="violation")
    return pareto.update_archive(held, rows.where("plan_id % 2 = 1"), OBJ, "plan_id", violation="violation")


@query("flt_extremes", """
SELECT (SELECT plan_id FROM o_sky ORDER BY energy, plan_id LIMIT 1) AS least_energy, (SELECT plan_id FROM o_sky ORDER BY emissions, plan_id LIMIT 1) AS cleanest, (SELECT plan_id FROM o_sky ORDER BY cost, plan_id LIMIT 1) AS cheapest,
  (SELECT plan_id FROM (SELECT plan_id, sqrt(pow((emissions - min(emissions) OVER ()) / (max(emissions) OVER () - min(emissions) OVER ()), 2) + pow((cost - min(cost) OVER ()) / (max(cost) OVER () - min(cost) OVER ()), 2)) AS d FROM o_sky) ORDER BY d, plan_id LIMIT 1) AS balanced""")
def _(t: Inputs):
    return fleet.extremes(front(t))
