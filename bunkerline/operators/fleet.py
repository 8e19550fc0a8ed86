"""Fleet plans over tables: candidates, scoring, feasibility and small exact solutions.

A scenario (routes, fuels, year, prices) is a short list the caller writes down; it travels as
one literal struct. Vessels and plans are tables of any size. Scoring an assignment is a
projection; scoring a plan is one aggregation by plan with map-side combining, so a plan that
holds a large share of all assignments is combined before it is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bunkerline import dims
from bunkerline import reference as ref
from bunkerline.functions.expr import clip, float_bin, md5_uniform
from bunkerline.operators import emissions, tank

FAILURES = (
    "route_compatibility", "fuel_compatibility", "fuel_availability", "range", "schedule", "no_trips_possible",
)
DEFAULT_FUELS = ("mgo", "hfo", "lng", "methanol")


@dataclass(frozen=True)
class Route:
    name: str
    ports: tuple[str, ...]
    distance_nmi: float
    annual_demand_t: float
    max_transit_hours: float | None = None


@dataclass(frozen=True)
class Scenario:
    routes: tuple[Route, ...]
    fuels: tuple[str, ...] = DEFAULT_FUELS
    year: int = 2030
    name: str = "base"
    carbon_price_inr_per_t: float = 0.0
    emission_cap_tco2e: float | None = None
    pathways: Mapping[str, str] = field(default_factory=dict)
    prices: Mapping[str, float] = field(default_factory=dict)

    def pathway(self, fuel: str) -> str:
        return self.pathways.get(fuel) or default_pathways([fuel])[fuel]

    def price(self, fuel: str) -> float:
        return {**ref.FUEL_PRICES_INR_PER_GJ, **self.prices}[fuel]

    def grey_defaults(self) -> list[str]:
        """Fuels left on a grey pathway, worth telling the reader."""
        return [f for f in self.fuels if self.pathway(f) == "grey"]

    def problems(self) -> list[str]:
        found = []
        known = {p[0] for p in ref.PORTS}
        for fuel in self.fuels:
            if fuel not in emissions.FUEL:
                found.append(f"unknown fuel {fuel}")
            elif fuel not in {**ref.FUEL_PRICES_INR_PER_GJ, **self.prices}:
                found.append(f"no price for {fuel}")
        for r in self.routes:
            found += [f"{r.name}: unknown port {p}" for p in r.ports if p not in known]
            if r.distance_nmi <= 0:
                found.append(f"{r.name}: distance must be positive")
            if r.annual_demand_t < 0:
                found.append(f"{r.name}: demand cannot be negative")
            if len(r.ports) < 2:
                found.append(f"{r.name}: needs two ports")
        return found


# fixed values: the coastal demonstration routes and the two-vessel instance's route
COASTAL_ROUTES = (
    Route("Mumbai-Cochin", ("mumbai", "cochin"), 560.0, 900000.0),
    Route("Mumbai-Mormugao", ("mumbai", "mormugao"), 230.0, 600000.0),
    Route("Cochin-Thoothukudi", ("cochin", "vo_chidambaranar"), 320.0, 450000.0),
)
COASTAL = Scenario(COASTAL_ROUTES, carbon_price_inr_per_t=2000.0, name="coastal")
TINY = Scenario((Route("Mumbai-Cochin", ("mumbai", "cochin"), 560.0, 250000.0),), ("mgo", "hfo"), name="tiny")
TUG = Scenario((Route("Harbour-duty", ("mormugao", "mormugao"), 25.0, 60000.0),), ("mgo", "methanol", "hydrogen"), name="tug")


# fixed values: the two-vessel instance; name, class, capacity, certificate, min and max speed, tank, cost, hours
TINY_VESSELS = [
    ("Coastal-A", "general_cargo", 8000.0, 18.0, 8.0, 15.0, 900.0, 9.0e7, 7000.0),
    ("Coastal-B", "general_cargo", 6000.0, 22.0, 8.0, 14.0, 700.0, 7.5e7, 7000.0),
]
VESSEL_COLUMNS = (
    "vessel string, vessel_class string, capacity_t double, design_efficiency_gco2_per_t_nmi double, min_speed_kn double, "
    "max_speed_kn double, tank_volume_m3 double, annual_cost_inr double, available_hours double"
)


def generated_fleet(indices: DataFrame, kind: str, index: str = "index") -> DataFrame:
    """Candidate vessels of any number, one per index: kind coastal, tug or large.

    Values are digests of kind and index in the published ranges, so any task can draw any
    vessel and a larger fleet contains the smaller one.
    """
    def u(what: str) -> Column:
        return md5_uniform(F.lit(kind), F.col(index), F.lit(what))

    def between(what: str, low: float, high: float) -> Column:
        return low + u(what) * (high - low)

    def pick(what: str, *values: float) -> Column:
        options = F.array(*[F.lit(float(v)) for v in values])
        return F.element_at(options, (F.floor(u(what) * len(values)) + 1).cast("int"))

    number = F.col(index).cast("string")
    if kind == "coastal":
        fixed = ref.COASTAL_FLEET
        capacity = pick("capacity", *fixed["capacity_t"])
        columns = [F.concat(F.lit("Coastal-"), number), F.when(capacity < fixed["bulk_from_t"], "general_cargo").otherwise("bulk_carrier"), capacity,
                   between("design", *fixed["design_gco2"]), F.lit(fixed["min_speed_kn"]), pick("speed", *fixed["max_speed_kn"]),
                   capacity / fixed["capacity_per_tank_m3"], capacity * fixed["cost_inr_per_t"], between("hours", *fixed["hours"])]
    elif kind == "tug":
        fixed = ref.TUG_FLEET
        columns = [F.concat(F.lit("Tug-"), number), F.lit("harbour_tug"), F.lit(fixed["capacity_t"]), F.lit(None).cast("double"), F.lit(fixed["min_speed_kn"]),
                   F.lit(fixed["max_speed_kn"]), between("tank", *fixed["tank_m3"]), between("cost", *fixed["cost_inr"]), between("hours", *fixed["hours"])]
    elif kind == "large":
        fixed = ref.LARGE_FLEET
        columns = [F.concat(F.lit("V"), number), F.when(F.col(index) % fixed["general_cargo_every"] == 0, "general_cargo").otherwise("bulk_carrier"),
                   between("capacity", *fixed["capacity_t"]), between("design", *fixed["design_gco2"]), F.lit(fixed["min_speed_kn"]),
                   between("speed", *fixed["max_speed_kn"]), between("tank", *fixed["tank_m3"]), between("cost", *fixed["cost_inr"]), between("hours", *fixed["hours"])]
    else:
        raise ValueError(f"kind must be coastal, tug or large, not {kind!r}")
    names = [part.strip().split(" ")[0] for part in VESSEL_COLUMNS.split(",")]
    return indices.select(F.col(index).alias("vessel_key"), *[c.alias(n) for n, c in zip(names, columns, strict=True)])


def default_pathways(fuels: Sequence[str]) -> dict[str, str]:
    """The only pathway, else fossil, else grey, else the first listed."""
    chosen = {}
    for fuel in fuels:
        listed = [p for f, p, *_ in ref.PATHWAYS if f == fuel]
        preferred = [p for p in ("fossil", "grey") if p in listed]
        chosen[fuel] = (preferred or listed)[0] if len(listed) != 1 else listed[0]
    return chosen


def _usable_at(port: str, fuel: str, year: int) -> bool:
    past = [(y, s) for p, f, y, s in ref.AVAILABILITY if p == port and f == fuel and y <= year]
    return bool(past) and max(past)[1] in ref.USABLE_STATUS


def _per_mj(fuel: str, pathway: str) -> float:
    """Lifecycle tonnes per MJ of shaft work with the fuel's default engine and its pilot."""
    props = emissions.FUEL[fuel]
    ch4, n2o = emissions.gwp(ref.DEFAULT_GWP_SET)
    _, pilot_fuel, pilot_pathway, share = emissions.PILOT.get(fuel, (fuel, None, None, 0.0))
    _, _, wtt, biogenic, _ = emissions.PATHWAY[(fuel, pathway)]
    main = (1.0 - share) / props["efficiency"]
    mass = main / props["lhv"] / 1000.0
    slip = next((pct / 100.0 for f, e, pct in ref.SLIPS if f == fuel and e == props["default_engine"]), 0.0)
    methane = mass * slip * ch4 if slip else main * props["ch4_g_mj"] / 1e6 * ch4
    total = main * wtt / 1e6 + (0.0 if biogenic else mass * props["cf"]) + methane + main * props["n2o_g_mj"] / 1e6 * n2o
    return total + (share * emissions.total_per_mj(pilot_fuel, pilot_pathway) if pilot_fuel else 0.0)


def scenario_literal(s: Scenario) -> Column:
    """The scenario's constants as one struct."""
    if s.problems():
        raise ValueError("; ".join(s.problems()))
    routes = F.array(*[
        F.struct(
            F.lit(r.name).alias("name"), F.lit(float(r.distance_nmi)).alias("nmi"),
            F.lit(float(r.annual_demand_t)).alias("demand"), F.lit(r.max_transit_hours).cast("double").alias("max_hours"),
            F.array(*[F.lit(f) for f in s.fuels if all(_usable_at(p, f, s.year) for p in r.ports)]).cast("array<string>").alias("fuels"),
        ) for r in s.routes
    ])
    fuels = F.array(*[
        F.struct(
            F.lit(f).alias("name"), F.lit(s.pathway(f)).alias("pathway"), F.lit(s.price(f)).alias("price"),
            F.lit(emissions.FUEL[f]["efficiency"]).alias("efficiency"),
            F.lit(_per_mj(f, s.pathway(f))).alias("t_per_mj"), F.lit(tank.DENSITY[f]).alias("density"),
        ) for f in s.fuels
    ])
    return F.struct(
        F.lit(s.name).alias("name"), F.lit(s.year).alias("year"), routes.alias("routes"), fuels.alias("fuels"),
        F.lit(float(s.carbon_price_inr_per_t)).alias("carbon_price"),
        F.lit(s.emission_cap_tco2e).cast("double").alias("cap"),
    )


def validate_vessels(vessels: DataFrame) -> DataFrame:
    """Violations: (rule, vessel)."""
    rules = F.array_compact(F.array(
        F.when((F.col("min_speed_kn") <= 0) | (F.col("max_speed_kn") <= F.col("min_speed_kn")), F.lit("speed_bounds")),
        F.when(F.coalesce(F.col("capacity_t") <= 0, F.lit(True)), F.lit("capacity")),
    ))
    return vessels.select(F.explode(rules).alias("rule"), "vessel")


def vessel_features(vessels: DataFrame, year: int, keep: Sequence[str] = ("vessel",)) -> DataFrame:
    """The model's inputs for candidate vessels in a planning year."""
    design = F.col("design_efficiency_gco2_per_t_nmi")
    zero = F.lit(0)
    return vessels.select(
        *keep, "vessel_class", design, design.isNotNull().cast("int").alias("has_design_efficiency"),
        F.lit(1).alias("efficiency_metric_eiv"), zero.alias("efficiency_metric_eedi"), zero.alias("efficiency_metric_eexi"),
        zero.alias("has_ice_class"), F.lit(0.0).alias("ice_class_ordinal"), F.lit(0.0).alias("ice_time_share"),
        F.lit(float(year)).alias("reporting_period"), F.col("available_hours").alias("time_at_sea_h"),
    )


def fallback_intensity(capacity: Column, speed: Column) -> Column:
    """Shaft MJ per mile without a fitted model: proportional to capacity, square in speed."""
    return 2500.0 * (capacity / 20000.0) * F.pow(speed / 14.0, 2.0)


def energy_intensity(df: DataFrame, speed: Column) -> Column:
    """From the vessel's speed curve where the rows carry one, else the fallback."""
    curve = ["reference_intensity_mj_per_nmi", "reference_speed_kn", "aux_share"]
    if not set(curve) <= set(df.columns):
        return fallback_intensity(F.col("capacity_t"), speed)
    level, at, aux = (F.col(c) for c in curve)
    power = level * at / 3.6 * ((1.0 - aux) * F.pow(speed / at, 3.0) + aux)
    return power * 3.6 / speed


def allowed(names: str, column: Column) -> Column:
    """True where the vessel's list (null: all) holds the value."""
    return F.coalesce(F.array_contains(F.col(names), column), F.lit(True))


def score_assignments(rows: DataFrame, scenarios: Sequence[Scenario]) -> DataFrame:
    """Score (vessel columns, route_idx, fuel_idx, speed_kn) rows under every scenario.

    Speed is clamped and the overflow recorded; then the first failing check of route, fuel,
    availability, range, schedule and trips stops the vessel and sets ``failure``.
    """
    if len(scenarios) == 1:
        out = rows.withColumn("_s", scenario_literal(scenarios[0]))
    else:
        out = rows.withColumn("_s", F.explode(F.array(*[scenario_literal(s) for s in scenarios])))
    n_routes, n_fuels = F.size("_s.routes"), F.size("_s.fuels")
    speed = F.least(F.greatest(F.col("speed_kn"), F.col("min_speed_kn")), F.col("max_speed_kn"))
    out = out.withColumns({
        "_route": F.element_at("_s.routes", (F.pmod("route_idx", n_routes) + 1).cast("int")),
        "_fuel": F.element_at("_s.fuels", (F.pmod("fuel_idx", n_fuels) + 1).cast("int")),
        "sailed_kn": speed,
    })
    overflow = F.abs(F.col("speed_kn") - F.col("sailed_kn"))
    out = out.withColumns({
        "speed_violation": F.when(overflow > 1e-9, overflow).otherwise(0.0),
        "energy_per_nmi_mj": energy_intensity(out, F.col("sailed_kn")),
        "_nmi": F.col("_route.nmi"), "_density": F.col("_fuel.density"),
    })
    nmi, intensity, density = F.col("_nmi"), F.col("energy_per_nmi_mj"), F.col("_density")
    out = out.withColumns({
        "range_nmi": tank.range_nmi(F.col("tank_volume_m3"), intensity, density),
        "cargo_displaced_t": tank.cargo_displaced(nmi, intensity, density, F.lit(tank.DENSITY["mgo"])),
        "_trip_hours": 2.0 * nmi / F.col("sailed_kn"),
    })
    hours, per_trip = F.col("available_hours"), F.col("_trip_hours")
    # floor of the exact quotient: a plain division could round up to the next whole trip
    out = out.withColumn("_trips", F.round((hours - hours % per_trip) / per_trip))
    late = nmi / F.col("sailed_kn") - F.col("_route.max_hours")
    failure = (
        F.when(~allowed("compatible_routes", F.col("_route.name")), FAILURES[0])
        .when(~allowed("compatible_fuels", F.col("_fuel.name")), FAILURES[1])
        .when(~F.array_contains("_route.fuels", F.col("_fuel.name")), FAILURES[2])
        .when(~tank.covers(F.col("range_nmi"), nmi), FAILURES[3])
        .when(F.coalesce(late > 0, F.lit(False)), FAILURES[4])
        .when(F.col("_trips") <= 0, FAILURES[5])
    )
    out = out.withColumn("failure", failure)
    out = out.withColumn(
        "failure_violation",
        F.when(F.col("failure") == FAILURES[3], (nmi - F.col("range_nmi")) / nmi)
        .when(F.col("failure") == FAILURES[4], late)
        .when(F.col("failure").isNotNull(), 1.0).otherwise(0.0),
    )
    good = F.col("failure").isNull()
    trips = F.when(good, F.col("_trips")).otherwise(0.0)
    capacity = F.greatest(F.lit(0.0), F.col("capacity_t") - F.col("cargo_displaced_t"))
    out = out.withColumns({"trips": trips.cast("bigint"), "_shaft": trips * (2.0 * nmi) * intensity})
    out = out.withColumns({
        "delivered_t": F.when(good, trips * capacity).otherwise(0.0),
        "fuel_energy_mj": F.col("_shaft") / F.col("_fuel.efficiency"),
        "emissions_t": F.col("_shaft") * F.col("_fuel.t_per_mj"),
    })
    cost = (
        F.col("fuel_energy_mj") / 1000.0 * F.col("_fuel.price") + F.col("annual_cost_inr")
        + F.col("emissions_t") * F.col("_s.carbon_price")
    )
    out = out.withColumns({
        "cost_inr": F.when(good, cost).otherwise(0.0), "scenario": F.col("_s.name"),
        "route": F.col("_route.name"), "fuel": F.col("_fuel.name"),
    })
    return out.drop("_s", "_route", "_fuel", "_nmi", "_density", "_trip_hours", "_trips", "_shaft")


def score_plans(scored: DataFrame, scenarios: Sequence[Scenario], keys: Sequence[str] = ("plan_id",)) -> DataFrame:
    """Objectives, violations and deliveries per plan (and scenario).

    Routes are the scenario's short list, so each is one conditional sum: a route no vessel of a
    plan serves still counts as unmet demand, without joining plans to routes.
    """
    names = list(dict.fromkeys(r.name for s in scenarios for r in s.routes))
    total = scored.groupBy(*keys, "scenario").agg(
        F.count(F.lit(1)).alias("deployed"),
        F.sum("fuel_energy_mj").alias("energy_mj"), F.sum("emissions_t").alias("emissions_t"),
        F.sum("cost_inr").alias("cost_inr"), F.sum("speed_violation").alias("_v_speed_bounds"),
        *[F.sum(F.when(F.col("failure") == f, F.col("failure_violation")).otherwise(0.0)).alias(f"_v_{f}") for f in FAILURES],
        *[F.sum(F.when(F.col("route") == n, F.col("delivered_t")).otherwise(0.0)).alias(f"_d_{i}") for i, n in enumerate(names)],
    )
    parts: dict[str, Column] = {"speed_bounds": F.col("_v_speed_bounds"), **{f: F.col(f"_v_{f}") for f in FAILURES}}
    delivered: dict[str, Column] = {}
    for i, name in enumerate(names):
        demand = F.lit(None).cast("double")
        for s in scenarios:
            for r in s.routes:
                if r.name == name:
                    demand = F.when(F.col("scenario") == s.name, float(r.annual_demand_t)).otherwise(demand)
        short = demand - F.col(f"_d_{i}")
        parts[f"demand:{name}"] = F.when(short > 1e-9, short / F.greatest(demand, F.lit(1.0))).otherwise(0.0)
        delivered[name] = F.col(f"_d_{i}")
    cap = F.lit(None).cast("double")
    for s in scenarios:
        if s.emission_cap_tco2e is not None:
            cap = F.when(F.col("scenario") == s.name, float(s.emission_cap_tco2e)).otherwise(cap)
    excess = F.col("emissions_t") - cap
    parts["emission_cap"] = F.when(excess > 1e-9, excess / F.greatest(cap, F.lit(1.0))).otherwise(0.0)
    violation = reduce(lambda a, b: a + b, parts.values())
    listed = F.map_from_entries(F.filter(
        F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in parts.items()]), lambda e: e["v"] > 0))
    return total.select(
        *keys, "scenario", "deployed", "energy_mj", "emissions_t", "cost_inr", violation.alias("violation"),
        listed.alias("violations"),
        F.map_from_arrays(F.array(*[F.lit(n) for n in delivered]), F.array(*delivered.values())).alias("delivered"),
        reduce(lambda a, b: a + b, delivered.values()).alias("cargo_t"),
    ).withColumn("feasible", F.col("violation") <= 1e-9)


def candidates(vessels: DataFrame, scenario: Scenario, bands: int) -> DataFrame:
    """Vessel x route x fuel x speed band: a bounded explode of the scenario's short lists."""
    combos = F.array(*[
        F.struct(F.lit(r).alias("route_idx"), F.lit(f).alias("fuel_idx"), F.lit(b).alias("band"))
        for r in range(len(scenario.routes)) for f in range(len(scenario.fuels)) for b in range(bands)
    ])
    step = (F.col("max_speed_kn") - F.col("min_speed_kn")) / (bands - 1)
    return vessels.select("*", F.explode(combos).alias("_c")).select("*", "_c.*").drop("_c").withColumn(
        "speed_kn", F.col("min_speed_kn") + F.col("band") * step)


def max_capacity(vessels: DataFrame, scenario: Scenario) -> DataFrame:
    """Best-case annual delivery per route: every compatible vessel at full speed."""
    def best(r: Route) -> Column:
        per_trip = 2.0 * r.distance_nmi / F.col("max_speed_kn")
        trips = F.round((F.col("available_hours") - F.col("available_hours") % per_trip) / per_trip)
        return F.sum(F.when(allowed("compatible_routes", F.lit(r.name)), F.greatest(trips, F.lit(0.0)) * F.col("capacity_t")).otherwise(0.0))

    sums = vessels.agg(*[best(r).alias(f"r{i}") for i, r in enumerate(scenario.routes)])
    return sums.select(F.explode(F.array(*[
        F.struct(F.lit(r.name).alias("route"), F.lit(float(r.annual_demand_t)).alias("demand_t"), F.col(f"r{i}").alias("best_t"))
        for i, r in enumerate(scenario.routes)
    ])).alias("x")).select("x.*")


def demand_check(vessels: DataFrame, scenario: Scenario) -> DataFrame:
    """Routes whose demand no plan can meet, with the shortfall spelled out."""
    short = F.col("demand_t") - F.col("best_t")
    return max_capacity(vessels, scenario).where(F.col("demand_t") > F.col("best_t") + 1e-9).select(
        "route", "demand_t", "best_t", short.alias("short_t"),
        F.format_string("%s: demand %s t exceeds the best case %s t by %s t", "route", F.format_number("demand_t", 0),
                        F.format_number("best_t", 0), F.format_number(short, 0)).alias("problem"))


def search_space(fleet_size: Column, scenario: Scenario) -> Column:
    return F.pow(F.lit(1.0 + len(scenario.routes) * len(scenario.fuels)), fleet_size.cast("double"))


# --------------------------------------------------------------------------- encodings


def bit_width(options: int) -> int:
    return max(1, (max(options, 2) - 1).bit_length())


def encode_bits(plans: DataFrame, scenario: Scenario) -> DataFrame:
    """Add ``bits``: deploy, route and fuel bits of each assignment, most significant first."""
    def number(column: str, count: int) -> Column:
        return F.lpad(F.bin(F.pmod(F.col(column), F.lit(count))), bit_width(count), "0")

    return plans.withColumn("bits", F.concat(
        F.when(F.col("deploy"), "1").otherwise("0"), number("route_idx", len(scenario.routes)), number("fuel_idx", len(scenario.fuels))))


def decode_bits(rows: DataFrame, scenario: Scenario, plan: str = "plan_id", order: str = "vessel_key") -> DataFrame:
    """(plan, vessel, bits, speed_kn, speed bounds) to decisions; every pattern is valid.

    An empty plan deploys its first vessel. Whether a plan is empty is an aggregate joined back,
    not a window over the plan.
    """
    r, f = bit_width(len(scenario.routes)), bit_width(len(scenario.fuels))

    def number(start: int, width: int) -> Column:
        return F.conv(F.substring("bits", start, width), 2, 10).cast("int")

    out = rows.withColumns({
        "_on": F.substring("bits", 1, 1) == "1",
        "route_idx": number(2, r) % len(scenario.routes), "fuel_idx": number(2 + r, f) % len(scenario.fuels),
        "decoded_speed_kn": F.least(F.greatest("speed_kn", "min_speed_kn"), F.col("max_speed_kn")),
    })
    return deploy_first_if_empty(out, "_on", plan, F.col(order)).drop("_on")


def deploy_first_if_empty(rows: DataFrame, flag: str, plan: str, preference: Column) -> DataFrame:
    """Add ``deploy``; a plan without any deployed vessel gets the one with the least preference."""
    rows = rows.withColumn("_p", preference)
    plans = rows.groupBy(plan).agg(F.max(flag).alias("_any"), F.min("_p").alias("_first"))
    return rows.join(plans, plan).withColumn(
        "deploy", F.col(flag) | (~F.col("_any") & (F.col("_p") == F.col("_first")))
    ).drop("_any", "_first", "_p")


def random_plans(members: DataFrame, scenario: Scenario, seed: int = 1000) -> DataFrame:
    """Uniform plans over (plan_id, vessel_key, speed bounds): deploy with p = 0.5, at least one.

    The draws are digests of seed, plan, vessel and purpose: any task can redo them.
    """
    def u(purpose: str) -> Column:
        return md5_uniform(F.lit(seed), F.col("plan_id"), F.col("vessel_key"), F.lit(purpose))

    rows = members.withColumns({
        "_on": u("deploy") < 0.5,
        "route_idx": F.floor(u("route") * len(scenario.routes)).cast("int"),
        "fuel_idx": F.floor(u("fuel") * len(scenario.fuels)).cast("int"),
        "speed_kn": F.col("min_speed_kn") + u("speed") * (F.col("max_speed_kn") - F.col("min_speed_kn")),
    })
    pick = F.struct(u("pick").alias("u"), F.col("vessel_key").alias("v"))
    return deploy_first_if_empty(rows, "_on", "plan_id", pick).drop("_on")


def real_decode(rows: DataFrame, scenario: Scenario) -> DataFrame:
    """Real-coded (plan, vessel, x_deploy, x_route, x_fuel, x_speed) in [0, 1] to decisions."""
    def index(column: str, count: int) -> Column:
        return clip(F.floor(F.col(column) * count), 0, count - 1).cast("int")

    out = rows.withColumns({
        "_on": F.col("x_deploy") > 0.5,
        "route_idx": index("x_route", len(scenario.routes)), "fuel_idx": index("x_fuel", len(scenario.fuels)),
        "speed_kn": F.col("min_speed_kn") + F.col("x_speed") * (F.col("max_speed_kn") - F.col("min_speed_kn")),
    })
    # an empty plan deploys its largest x_deploy, the first of equals
    pick = F.struct((-F.col("x_deploy")).alias("u"), F.col("vessel_key").alias("v"))
    return deploy_first_if_empty(out, "_on", "plan_id", pick).drop("_on")


# --------------------------------------------------------------------------- reports


def bau_intensity(rows: DataFrame, scenario: Scenario) -> DataFrame:
    """Tonnes CO2e per tonne of cargo if the same deployment burned fossil diesel, per plan."""
    diesel = replace(scenario, fuels=("mgo",), pathways={"mgo": "fossil"}, name=scenario.name)
    scored = score_assignments(rows.withColumn("fuel_idx", F.lit(0)), [diesel])
    sums = scored.groupBy("plan_id").agg(F.sum("emissions_t").alias("_e"), F.sum("delivered_t").alias("_c"))
    return sums.select("plan_id", F.when(F.col("_c") > 0, F.col("_e") / F.col("_c")).alias("bau_intensity"))


def plan_report(scored: DataFrame) -> DataFrame:
    """Per plan: vessels, cargo and fuel mix. The assignments stay the long table ``scored``.

    Counted per (plan, fuel) first, so a plan of any size reaches the second step as a few rows.
    """
    fuels = scored.groupBy("plan_id", "fuel").agg(
        F.count(F.lit(1)).alias("n"), F.sum("delivered_t").alias("cargo"))
    return fuels.groupBy("plan_id").agg(
        F.sum("n").alias("deployed"), F.sum("cargo").alias("cargo_t"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("fuel", "n")))).alias("fuel_mix"),
    )


def extremes(front: DataFrame, key: str = "plan_id", objectives: Sequence[str] = ("energy", "emissions", "cost")) -> DataFrame:
    """Least-energy, cleanest and cheapest plan and the knee nearest the ideal (emissions, cost)."""
    energy, emission, cost = objectives
    spans = front.agg(*[f(c).alias(f"_{n}_{c}") for c in objectives for n, f in (("lo", F.min), ("hi", F.max))])

    def scaled(c: str) -> Column:
        span = F.col(f"_hi_{c}") - F.col(f"_lo_{c}")
        return (F.col(c) - F.col(f"_lo_{c}")) / F.when(span == 0, 1.0).otherwise(span)

    rows = front.withColumn("_k", F.lit(1)).join(F.broadcast(spans.withColumn("_k", F.lit(1))), "_k")
    distance = F.sqrt(scaled(emission) * scaled(emission) + scaled(cost) * scaled(cost))
    return rows.withColumn("_knee", distance).agg(
        *[F.min_by(key, F.struct(c, key)).alias(n) for n, c in (("least_energy", energy), ("cleanest", emission), ("cheapest", cost))],
        F.min_by(key, F.struct("_knee", key)).alias("balanced"),
    )


# --------------------------------------------------------------------------- greedy


def greedy(vessels: DataFrame, scenario: Scenario, group: str, fractions: int = 11) -> DataFrame:
    """Cheapest capacity first, each vessel to the largest unmet route, per (group, speed, fuel).

    The choice depends on what is left, so it is sequential inside one (group, fraction, fuel);
    those are independent and spread over tasks. Vessels that can only come after all demand is
    met are cut off beforehand, so what a task reads is set by the demand and not by the table,
    and it is consumed as a stream with one number per route as state.
    """
    combos = F.array(*[
        F.struct(F.lit(i).alias("fraction"), F.lit(f).alias("fuel_idx")) for i in range(fractions) for f in range(len(scenario.fuels))
    ])
    span = F.col("max_speed_kn") - F.col("min_speed_kn")
    same = [group, "vessel", "vessel_key", "_order"]
    fleet = vessels.dropDuplicates().withColumn("_order", F.col("annual_cost_inr") / F.col("capacity_t"))
    fleet = fleet.withColumn("_rows", F.count(F.lit(1)).over(Window.partitionBy(*same)))
    wide = fleet.select("*", F.explode(combos).alias("_c")).select("*", "_c.*").drop("_c").withColumn(
        "speed_kn", F.col("min_speed_kn") + F.col("fraction") / (fractions - 1.0) * span)
    keys, fields = [group, "fraction", "fuel_idx"], ("delivered_t", "fuel_energy_mj", "emissions_t", "cost_inr", "failure_violation")
    for i in range(len(scenario.routes)):  # routes side by side in the row: only vessels are shuffled
        scored = score_assignments(wide.withColumn("route_idx", F.lit(i)), [scenario])
        wide = scored.select(*wide.columns, F.struct(*fields).alias(f"r{i}"))
    routes = [f"r{i}" for i in range(len(scenario.routes))]
    once = wide.where("_rows = 1").select(*keys, *same[1:], *routes)
    # rows of one vessel that differ count by their best value on each route
    more = wide.where("_rows > 1").groupBy(*keys, *same[1:]).agg(*[F.max(r).alias(r) for r in routes])
    flat = once.unionByName(more).select(*keys, *same[1:], *[
        F.col(f"{r}.{c}").alias(f"{c}_{i}") for i, r in enumerate(routes) for c in fields
    ])
    demands = [float(r.annual_demand_t) for r in scenario.routes]
    flat = _before_demand_is_met(flat, keys, [float(r.annual_demand_t) for r in scenario.routes])
    ordered = flat.repartition(*keys).sortWithinPartitions(*keys, "_order", "vessel_key")
    return ordered.mapInPandas(
        _greedy_stream(keys, demands),
        f"{group} {dict(vessels.dtypes)[group]}, fraction int, fuel_idx int, vessel string, route_idx int, "
        "delivered_t double, fuel_energy_mj double, emissions_t double, cost_inr double, failure_violation double",
    )


def _before_demand_is_met(flat: DataFrame, keys: list[str], demands: list[float]) -> DataFrame:
    """Drop vessels no greedy run can reach.

    A vessel takes at least its smallest delivery off some unmet route, or finishes that route,
    which happens once per route. So once the smallest deliveries of all earlier vessels pass
    total demand plus one largest vessel per route, nothing is left to serve.
    """
    deliveries = [F.coalesce(F.col(f"delivered_t_{i}"), F.lit(0.0)) for i in range(len(demands))]
    least = F.least(*deliveries) if len(deliveries) > 1 else deliveries[0]
    binned = flat.withColumns({"_least": least, "_bin": float_bin(F.col("_order"))})
    sums = binned.groupBy(*keys, "_bin").agg(F.sum("_least").alias("_sum"), F.max("_least").alias("_max"))
    earlier = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    limit = sum(demands) + len(demands) * F.max("_max").over(Window.partitionBy(*keys))
    kept = sums.select(*keys, "_bin", (F.coalesce(F.sum("_sum").over(earlier), F.lit(0.0)) <= limit).alias("_keep"))
    return binned.join(kept.where("_keep"), [*keys, "_bin"], "left_semi").drop("_least", "_bin")


def _greedy_stream(keys: list[str], demands: list[float]):
    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, left = None, []
        for batch in batches:
            picked = []
            for row in batch.to_dict("records"):
                here = tuple(row[k] for k in keys)
                if here != current:
                    current, left = here, list(demands)
                route = max(range(len(left)), key=left.__getitem__)
                if left[route] <= 0:
                    continue
                left[route] = max(0.0, left[route] - row[f"delivered_t_{route}"])
                picked.append((*here, row["vessel"], route, *[
                    row[f"{c}_{route}"] for c in ("delivered_t", "fuel_energy_mj", "emissions_t", "cost_inr", "failure_violation")]))
            yield pd.DataFrame(picked, columns=[*keys, "vessel", "route_idx", "delivered_t", "fuel_energy_mj", "emissions_t", "cost_inr", "failure_violation"])

    return assign


# --------------------------------------------------------------------------- small exact instances

MAX_ENUMERATION = 200_000


def instance_options(vessels: DataFrame, scenario: Scenario, instance: str, bands: int) -> DataFrame:
    """Per instance: one list of feasible options per vessel.

    The state count of each instance is aggregated first, and an instance above
    ``MAX_ENUMERATION`` fails before any of its rows is gathered: refused, never truncated.
    """
    scored = score_assignments(candidates(vessels, scenario, bands), [scenario]).where("failure is null")
    per_vessel = scored.groupBy(instance, "vessel_key").agg(F.count(F.lit(1)).alias("_options"))
    states = per_vessel.groupBy(instance).agg(F.sum(F.ln(1.0 + F.col("_options"))).alias("_ln_states"))
    # options and instances grow with the fleet, and Spark takes an explode's rows for as few as it was given: no broadcast
    checked = scored.join(states.hint("merge"), instance).withColumn(
        "vessel_key",
        F.when(F.col("_ln_states") <= math.log(MAX_ENUMERATION), F.col("vessel_key")).otherwise(
            F.raise_error(F.lit("instance too large to enumerate")).cast("bigint")))
    option = F.struct(
        F.col("cost_inr").alias("cost"), F.col("emissions_t").alias("emissions"), F.col("fuel_energy_mj").alias("energy"),
        F.col("delivered_t").alias("delivered"), F.col("route_idx").alias("route"), F.col("fuel_idx").alias("fuel"), F.col("band").alias("band"))
    listed = checked.groupBy(instance, "vessel_key").agg(F.collect_list(option).alias("options"))
    return listed.groupBy(instance).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("vessel_key", "options"))), lambda x: x["options"]).alias("fleet"))


def exact_small(vessels: DataFrame, scenario: Scenario, instance: str, bands: int = 5) -> DataFrame:
    """Proven optimum and exact front of every small single-route instance, by enumeration in the row."""
    if len(scenario.routes) != 1:
        raise ValueError("exact enumeration is for single-route instances")
    demand = float(scenario.routes[0].annual_demand_t)
    rows = instance_options(vessels, scenario, instance, bands)
    fields = ("cost", "emissions", "energy", "delivered")
    nothing = F.struct(*[F.lit(0.0).alias(c) for c in fields])

    def extend(states: Column, options: Column) -> Column:
        choices = F.concat(F.array(nothing), F.transform(options, lambda o: F.struct(*[o[c].alias(c) for c in fields])))
        return F.flatten(F.transform(states, lambda s: F.transform(
            choices, lambda o: F.struct(*[(s[c] + o[c]).alias(c) for c in fields]))))

    states = F.aggregate("fleet", F.array(nothing), extend)
    plans = F.filter(states, lambda p: p["delivered"] >= demand - 1e-9)
    if scenario.emission_cap_tco2e is not None:
        cap = scenario.emission_cap_tco2e
        plans = F.filter(plans, lambda p: p["emissions"] <= cap + 1e-9)
    rows = rows.withColumn("_plans", plans).where(F.size("_plans") > 0)

    def beats(q: Column, p: Column) -> Column:
        three = ("energy", "emissions", "cost")
        no_worse = reduce(lambda a, b: a & b, [q[c] <= p[c] for c in three])
        return no_worse & reduce(lambda a, b: a | b, [q[c] < p[c] for c in three])

    # in (cost, emissions, energy) order a dominating plan comes first: compare with the front so far
    ordered = F.array_sort("_plans")
    front = F.aggregate(
        ordered, F.slice(ordered, 1, 0),
        lambda held, p: F.when(F.exists(held, lambda q: beats(q, p)), held).otherwise(F.concat(held, F.array(p))))
    cheapest = F.array_min(F.transform("_plans", lambda p: F.struct(p["cost"], p["emissions"], p["energy"])))
    cleanest = F.array_min(F.transform("_plans", lambda p: F.struct(p["emissions"], p["cost"], p["energy"])))
    return rows.select(
        instance, F.size("_plans").alias("feasible_plans"),
        cheapest.alias("_c"), cleanest.alias("_e"),
        F.transform(front, lambda p: F.struct(p["energy"], p["emissions"], p["cost"])).alias("front"),
    ).select(
        instance, "feasible_plans", F.col("_c.cost").alias("min_cost_inr"), F.col("_c.emissions").alias("emissions_at_min_cost_t"),
        F.col("_e.emissions").alias("min_emissions_t"), F.size("front").alias("front_size"), "front",
    )


def qubo_variables(vessels: DataFrame, scenario: Scenario, instance: str, bands: int = 3) -> DataFrame:
    """Per instance: the ordered variables with cost and delivery, penalty weight and demand scale."""
    rows = instance_options(vessels, scenario, instance, bands)
    tagged = F.flatten(F.transform("fleet", lambda options, v: F.transform(
        F.sort_array(F.transform(options, lambda o: F.struct(o["route"], o["fuel"], o["band"], o["cost"], o["delivered"]))),
        lambda o: F.struct(v.alias("vessel"), o["route"].alias("route"), o["cost"].alias("cost"), o["delivered"].alias("delivered")))))
    out = rows.select(instance, tagged.alias("vars"))
    positive = F.filter(F.transform("vars", lambda x: x["delivered"]), lambda d: d > 0)
    mean = F.aggregate(positive, F.lit(0.0), lambda a, d: a + d) / F.size(positive)
    out = out.withColumn("penalty", F.array_max(F.transform("vars", lambda x: x["cost"])) * 10.0)
    return out.withColumn(
        "scale", F.when(F.size(positive) > 0, F.col("penalty") / F.greatest(mean * mean, F.lit(1.0))).otherwise(F.col("penalty")))


def qubo_terms(variables: DataFrame, scenario: Scenario, instance: str) -> DataFrame:
    """The matrix in coordinate form (instance, i, j, q), upper triangle, plus offset rows (-1, -1).

    The matrix itself is the product here; its size is set by the instance guard.
    """
    demand = F.array(*[F.lit(float(r.annual_demand_t)) for r in scenario.routes])

    def d_of(x: Column) -> Column:
        return F.element_at(demand, x["route"].cast("int") + 1)

    diagonal = F.transform("vars", lambda x, i: F.struct(i.alias("i"), i.alias("j"), (
        x["cost"] + F.col("scale") * (x["delivered"] * x["delivered"] - 2.0 * d_of(x) * x["delivered"])).alias("q")))

    def couple(x: Column, i: Column) -> Column:
        return F.transform("vars", lambda y, j: F.struct(i.alias("i"), j.alias("j"), F.when(j > i, (
            F.when(x["vessel"] == y["vessel"], F.col("penalty")).otherwise(0.0)
            + F.when(x["route"] == y["route"], 2.0 * F.col("scale") * x["delivered"] * y["delivered"]).otherwise(0.0))).alias("q")))

    pairs = F.filter(F.flatten(F.transform("vars", couple)), lambda t: t["q"] != 0)
    served = F.filter(F.sequence(F.lit(0), F.lit(len(scenario.routes) - 1)), lambda r: F.exists("vars", lambda x: x["route"] == r))
    offset = F.aggregate(served, F.lit(0.0), lambda a, r: a + F.col("scale") * F.pow(F.element_at(demand, r + 1), 2.0))
    terms = F.concat(diagonal, pairs, F.array(F.struct(F.lit(-1).alias("i"), F.lit(-1).alias("j"), offset.alias("q"))))
    return variables.select(instance, F.explode(terms).alias("t")).select(instance, "t.*")


def qubo_energy(variables: DataFrame, scenario: Scenario, instance: str, samples: int, seed: int = 1000) -> DataFrame:
    """Energy of sampled bit vectors without the matrix.

    x'Qx + offset equals the chosen cost, plus P for each pair chosen on one vessel, plus
    s * (demand - delivered)^2 per served route: linear in the variables.
    """
    rows = variables.select("*", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample"))
    chosen = F.filter(F.transform("vars", lambda x, i: F.struct(
        x["vessel"].alias("vessel"), x["route"].alias("route"), x["cost"].alias("cost"), x["delivered"].alias("delivered"),
        (md5_uniform(F.lit(seed), F.col(instance), F.col("sample"), i) < 0.4).alias("on"))), lambda x: x["on"])
    rows = rows.withColumn("_on", chosen)

    def total(column: str, condition=None) -> Column:
        return F.aggregate("_on", F.lit(0.0), lambda a, x: a + (x[column] if condition is None else F.when(condition(x), x[column]).otherwise(0.0)))

    vessels = F.array_distinct(F.transform("_on", lambda x: x["vessel"]))
    extra = F.aggregate(vessels, F.lit(0.0), lambda a, v: a + (
        F.size(F.filter("_on", lambda x: x["vessel"] == v)) * (F.size(F.filter("_on", lambda x: x["vessel"] == v)) - 1) / 2.0))
    energy = total("cost") + F.col("penalty") * extra
    for i, r in enumerate(scenario.routes):
        served = F.exists("vars", lambda x: x["route"] == i)
        gap = float(r.annual_demand_t) - total("delivered", lambda x: x["route"] == i)
        energy = energy + F.when(served, F.col("scale") * gap * gap).otherwise(0.0)
    n = F.size("vars")
    couplings = F.aggregate(
        F.transform("vars", lambda x: F.size(F.filter("vars", lambda y: (y["vessel"] == x["vessel"]) | ((y["route"] == x["route"]) & (x["delivered"] * y["delivered"] != 0)))) - 1),
        F.lit(0), lambda a, c: a + c) / 2.0
    return rows.select(instance, "sample", F.size("_on").alias("chosen"), energy.alias("energy"), ((couplings + n) / (n * n)).alias("density"))
