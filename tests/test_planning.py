import re
from dataclasses import replace
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bunkerline.operators import emissions, fleet, pareto, search
from bunkerline.operators.fleet import COASTAL, TINY, Route, Scenario

OBJ = ["x", "y", "z"]
VESSEL = ("vessel_key long, vessel string, vessel_class string, capacity_t double, design_efficiency_gco2_per_t_nmi double, min_speed_kn double, "
          "max_speed_kn double, tank_volume_m3 double, annual_cost_inr double, available_hours double, compatible_routes array<string>, compatible_fuels array<string>")


def vessel(key, **over):
    row = dict(vessel_key=key, vessel=f"V{key}", vessel_class="general_cargo", capacity_t=10000.0, design=18.0, lo=8.0, hi=15.0, tank=1000.0,
               cost=1e8, hours=7000.0, routes=None, fuels=None)
    row.update(over)
    return tuple(row.values())


@pytest.fixture(scope="module")
def lane():
    return Scenario((Route("Mumbai-Cochin", ("mumbai", "cochin"), 500.0, 200000.0),), ("mgo", "hfo", "methanol"), name="lane")


def scored(spark, lane, rows, plan=((0, 0, 10.0),)):
    vessels = spark.createDataFrame(rows, VESSEL)
    picks = spark.createDataFrame([(1, v[0], r, f, s) for v, (r, f, s) in zip(rows, plan)], "plan_id long, vessel_key long, route_idx int, fuel_idx int, speed_kn double")
    return fleet.score_assignments(picks.join(vessels, "vessel_key"), [lane])


def test_hand_calculated_assignment(spark, lane):
    r = scored(spark, lane, [vessel(1)]).first()
    per_nmi = 2500.0 * 0.5 * (10 / 14) ** 2
    shaft = 70 * 1000.0 * per_nmi
    assert r["trips"] == 70 and r["delivered_t"] == 700000.0 and r["failure"] is None
    assert r["fuel_energy_mj"] == pytest.approx(shaft / 0.45)
    assert r["emissions_t"] == pytest.approx(shaft * emissions.total_per_mj("mgo", "fossil"))
    assert r["cost_inr"] == pytest.approx(shaft / 0.45 / 1000 * 1500 + 1e8)


@pytest.mark.parametrize("over, pick, failure, violation", [
    (dict(routes=["Other"]), (0, 0, 10.0), "route_compatibility", 1.0),
    (dict(fuels=["hfo"]), (0, 0, 10.0), "fuel_compatibility", 1.0),
    (dict(), (0, 2, 10.0), "fuel_availability", 1.0),
    (dict(tank=1.0), (0, 0, 10.0), "range", None),
    (dict(hours=50.0), (0, 0, 10.0), "no_trips_possible", 1.0),
])
def test_first_failing_check(spark, lane, over, pick, failure, violation):
    r = scored(spark, lane, [vessel(1, **over)], [pick]).first()
    assert r["failure"] == failure and r["delivered_t"] == r["cost_inr"] == 0.0
    assert violation is None or r["failure_violation"] == violation


def test_schedule_and_speed_clamp(spark, lane):
    timed = replace(lane, routes=(replace(lane.routes[0], max_transit_hours=40.0),))
    r = scored(spark, timed, [vessel(1)]).first()
    assert r["failure"] == "schedule" and r["failure_violation"] == pytest.approx(10.0)
    fast = scored(spark, timed, [vessel(1)], [(0, 0, 20.0)]).first()
    assert fast["failure"] is None and fast["sailed_kn"] == 15.0 and fast["speed_violation"] == 5.0


def test_plan_totals_demand_and_cap(spark, lane):
    two = replace(lane, routes=(*lane.routes, Route("Idle", ("mumbai", "cochin"), 100.0, 1000.0)), emission_cap_tco2e=1.0)
    rows = [vessel(1), vessel(2, capacity_t=12000.0)]
    p = fleet.score_plans(scored(spark, two, rows, [(0, 0, 10.0), (0, 1, 9.0)]), [two]).first()
    assert p["delivered"]["Idle"] == 0.0 and p["violations"]["demand:Idle"] == 1.0
    assert p["violations"]["emission_cap"] == pytest.approx(p["emissions_t"] - 1.0) and not p["feasible"]
    assert p["violation"] == pytest.approx(sum(p["violations"].values()))


def test_scenario_checks():
    assert fleet.default_pathways(["hfo", "mgo", "ammonia", "hydrogen"]) == {"hfo": "fossil", "mgo": "fossil", "ammonia": "grey", "hydrogen": "grey"}
    assert Scenario(COASTAL.routes, ("ammonia", "mgo")).grey_defaults() == ["ammonia"]
    bad = Scenario((Route("r", ("atlantis",), -1.0, -1.0),), ("mgo", "peat"))
    assert len(bad.problems()) == 5
    assert COASTAL.problems() == TINY.problems() == fleet.TUG.problems() == []


def test_bits_round_trip(spark):
    rows = [(1, v, True, r, f, 9.0, 8.0, 15.0) for v, (r, f) in enumerate([(0, 0), (1, 3), (2, 2)])]
    df = spark.createDataFrame(rows, "plan_id long, vessel_key long, deploy boolean, route_idx int, fuel_idx int, speed_kn double, min_speed_kn double, max_speed_kn double")
    back = fleet.decode_bits(fleet.encode_bits(df, COASTAL).drop("deploy", "route_idx", "fuel_idx"), COASTAL).orderBy("vessel_key").collect()
    assert [(r["deploy"], r["route_idx"], r["fuel_idx"]) for r in back] == [(True, 0, 0), (True, 1, 3), (True, 2, 2)]
    empty = fleet.decode_bits(df.drop("deploy", "route_idx", "fuel_idx").withColumn("bits", F.lit("01100")), COASTAL).orderBy("vessel_key").collect()
    assert [r["deploy"] for r in empty] == [True, False, False] and {r["route_idx"] for r in empty} == {0}


def test_exact_small_matches_brute_force(spark):
    rows = [vessel(2, capacity_t=8000.0, cost=9e7, tank=900.0), vessel(3, capacity_t=6000.0, cost=7.5e7, tank=700.0, hi=14.0)]
    df = spark.createDataFrame(rows, VESSEL).withColumn("instance", F.lit(1).cast("bigint"))
    got = fleet.exact_small(df, TINY, "instance").first()
    options = {2: [(0, 0, 0, 0)], 3: [(0, 0, 0, 0)]}
    for r in fleet.score_assignments(fleet.candidates(df, TINY, 5), [TINY]).where("failure is null").collect():
        options[r["vessel_key"]].append((r["cost_inr"], r["emissions_t"], r["fuel_energy_mj"], r["delivered_t"]))
    plans = [tuple(np.add(a, b)) for a in options[2] for b in options[3]]
    plans = [p for p in plans if p[3] >= 250000 - 1e-9]
    assert got["feasible_plans"] == len(plans)
    assert got["min_cost_inr"] == pytest.approx(min(p[0] for p in plans)) and got["min_emissions_t"] == pytest.approx(min(p[1] for p in plans))
    dominated = lambda p: any(all(q[i] <= p[i] for i in range(3)) and any(q[i] < p[i] for i in range(3)) for q in plans)
    assert got["front_size"] == sum(not dominated(p) for p in plans)


def test_greedy_meets_demand(spark, lane):
    rows = [vessel(i, cost=1e8 + i) for i in range(6)]
    df = spark.createDataFrame(rows, VESSEL).withColumn("fleet", F.lit(1).cast("bigint"))
    many = replace(lane, routes=(replace(lane.routes[0], annual_demand_t=1500000.0),), fuels=("mgo",))
    out = fleet.greedy(df, many, "fleet", fractions=3).groupBy("fraction").agg(F.count("*").alias("n"), F.sum("delivered_t").alias("d"), F.min("vessel").alias("v")).collect()
    assert len(out) == 3
    for r in out:
        assert r["d"] >= 1500000.0 and r["v"] == "V0" and r["n"] <= 3


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(11)
    pts = rng.random((3000, 3))
    pts[:, 2] = 2.0 - pts[:, 0] - pts[:, 1] + rng.normal(0, 0.02, 3000)  # anti-correlated: a large front
    pts[1000:2000] = pts[0]  # a third of all rows is one vector
    pdf = pd.DataFrame(pts, columns=OBJ)
    pdf["id"] = np.arange(len(pdf))
    return pdf, spark.createDataFrame(pdf)


def brute(pdf):
    pts = pdf[OBJ].to_numpy()
    keep = np.ones(len(pts), dtype=bool)
    for i, p in enumerate(pts):
        keep[i] = not ((pts <= p).all(1) & (pts < p).any(1)).any()
    return set(pdf["id"][keep])


@pytest.mark.parametrize("cell_rows", [2048, 12])
def test_skyline_matches_brute_force(cloud, monkeypatch, cell_rows):
    monkeypatch.setattr(pareto, "CELL_ROWS", cell_rows)  # one cell, and a grid of many
    pdf, df = cloud
    assert {r["id"] for r in pareto.skyline(df, OBJ).collect()} == brute(pdf)


@pytest.mark.parametrize("d", [1, 2, 3, 4])
def test_front_of_any_number_of_objectives_over_many_cells(spark, monkeypatch, d):
    monkeypatch.setattr(pareto, "CELL_ROWS", 8)
    rng = np.random.default_rng(d)
    names = [f"o{i}" for i in range(d)]
    pts = rng.integers(0, 40, (900, d)).astype(float)  # many ties in every objective
    pts[:, -1] += 40.0 * d - pts[:, :-1].sum(axis=1)
    pdf = pd.DataFrame(pts, columns=names).assign(id=range(900), g=rng.integers(0, 3, 900))
    got = {r["id"] for r in pareto.skyline(spark.createDataFrame(pdf), names, by=["g"]).collect()}
    want = set()
    for _, own in pdf.groupby("g"):
        v = own[names].to_numpy()
        want |= {i for i, p in zip(own["id"], v) if not ((v <= p).all(1) & (v < p).any(1)).any()}
    assert got == want
    assert pareto.skyline(spark.createDataFrame(pdf).limit(0), names).count() == 0


def test_skyline_by_group_and_feasibility(cloud):
    pdf, df = cloud
    pdf = pdf.assign(g=pdf["id"] % 2, bad=(pdf["id"] % 5 == 0) * 0.5)
    df = df.withColumns({"g": F.col("id") % 2, "bad": F.when(F.col("id") % 5 == 0, 0.5).otherwise(0.0)})
    ok = pdf[pdf["bad"] == 0]
    want = brute(ok[ok["g"] == 0]) | brute(ok[ok["g"] == 1])
    assert {r["id"] for r in pareto.skyline(df, OBJ, "bad", ["g"]).collect()} == want


def test_nearest_distances_match_brute_force(cloud):
    pdf, df = cloud
    near = {r["id"]: r["nearest"] for r in pareto.nearest_distance(df, df, "id", OBJ, skip_self=True).collect()}
    pts = pdf[OBJ].to_numpy()
    d = np.sqrt(((pts[:, None, :] - pts[None, :, :]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    np.testing.assert_allclose([near[i] for i in pdf["id"]], d.min(1), rtol=1e-9, atol=1e-12)


def test_igd_and_spacing_edges(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0), (2, 3.0, 4.0)], "id int, x double, y double")
    assert pareto.igd(a.where("id = 1"), a, "id", ["x", "y"]).first()[0] == 2.5
    assert pareto.igd(a.where("id = 9"), a, "id", ["x", "y"]).first()[0] == float("inf")
    assert pareto.spacing(a.where("id = 1"), "id", ["x", "y"]).first()[0] == 0.0


def test_hypervolume(spark):
    one = spark.createDataFrame([(1.0, 1.0, 1.0)], "x double, y double, z double")
    assert pareto.hypervolume_2d(one, "x", "y", (2.0, 2.0)).first()[0] == 1.0
    assert pareto.hypervolume_3d(one, OBJ, (2.0, 2.0, 3.0)).first()[0] == 2.0
    stairs = spark.createDataFrame([(0.0, 2.0, 1.0), (1.0, 1.0, 0.0), (2.0, 0.0, 2.0)], "x double, y double, z double")
    assert pareto.hypervolume_2d(stairs, "x", "y", (3.0, 3.0)).first()[0] == 6.0
    cells = sum(any(p[0] <= i and p[1] <= j and p[2] <= k for p in [(0, 2, 1), (1, 1, 0), (2, 0, 2)]) for i in range(3) for j in range(3) for k in range(3))
    assert pareto.hypervolume_3d(stairs, OBJ, (3.0, 3.0, 3.0)).first()[0] == float(cells)


def volume(points, reference):
    """Boxes of a full grid of all coordinates that some point dominates."""
    axes = [np.unique(np.append(points[:, i][points[:, i] < reference[i]], reference[i])) for i in range(3)]
    total = 0.0
    for i, x in enumerate(axes[0][:-1]):
        for j, y in enumerate(axes[1][:-1]):
            below = points[(points[:, 0] <= x) & (points[:, 1] <= y)]
            if len(below):
                total += (axes[0][i + 1] - x) * (axes[1][j + 1] - y) * max(0.0, reference[2] - below[:, 2].min())
    return total


@pytest.mark.parametrize("range_rows", [7, 1 << 15])
def test_hypervolume_sweep_matches_boxes(spark, range_rows):
    rng = np.random.default_rng(4)
    directions = np.abs(rng.normal(size=(150, 3)))
    curved = 1 - directions / np.linalg.norm(directions, axis=1, keepdims=True)
    coarse = rng.integers(0, 6, (80, 3)).astype(float)
    flat = np.column_stack([np.arange(20.0), np.arange(20.0)[::-1], np.full(20, 1.0)])
    for points, reference in ((curved, (1.1, 0.9, 1.0)), (coarse, (5.0, 6.0, 5.0)), (flat, (30.0, 25.0, 2.0))):
        df = spark.createDataFrame([tuple(map(float, p)) for p in points], "x double, y double, z double")
        assert pareto.hypervolume_3d(df, OBJ, reference, range_rows).first()[0] == pytest.approx(volume(points, reference))
    assert pareto.hypervolume_3d(df.limit(0), OBJ, reference).first()[0] == 0.0


def test_nearest_by_group_and_far_targets(spark):
    rng = np.random.default_rng(8)
    cloud = [(f"g{i % 3}", *map(float, p)) for i, p in enumerate(rng.normal(size=(900, 2)))]
    found = spark.createDataFrame([*cloud, ("alone", 500.0, 500.0)], "g string, x double, y double")
    targets = [(i, g, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(30, 2)) * [1, 40]) for g in ("g0", "g1", "g2", "alone")]
    got = {(r["id"], r["g"]): r["nearest"] for r in pareto.nearest_distance(spark.createDataFrame(targets, "id int, g string, x double, y double"), found, "id", ["x", "y"], by=["g"]).collect()}
    pool = [*cloud, ("alone", 500.0, 500.0)]
    for i, g, x, y in targets:
        assert got[i, g] == pytest.approx(min(np.hypot(x - a, y - b) for k, a, b in pool if k == g))
    table = pareto.igd(found, spark.createDataFrame([(1, 0.0, 0.0)], "id int, x double, y double"), "id", ["x", "y"], "g")
    assert {r["g"] for r in table.collect()} == {"g0", "g1", "g2", "alone"}


def test_archive_keeps_spread(cloud):
    pdf, df = cloud
    held = pareto.update_archive(None, df, OBJ, "id", 20)
    rows = held.collect()
    assert len(rows) == 20 and {r["id"] for r in rows} <= brute(pdf)


def test_population_search_finds_feasible_plans(spark, lane):
    rows = [vessel(i, capacity_t=6000.0 + 500 * i) for i in range(4)]
    easy = replace(lane, fuels=("mgo", "hfo"), routes=(replace(lane.routes[0], annual_demand_t=300000.0),))
    seen = []
    archive, trace = search.search(spark.createDataFrame(rows, VESSEL), easy, individuals=4, generations=3, on_generation=lambda g, e: seen.append(g))
    got = archive.collect()
    assert got and all(r["violation"] <= 1e-9 for r in got) and seen == [0, 1, 2]
    assert trace[-1]["diversity"] <= 1.0 and trace[-1]["archive_size"] == len(got)


def test_rotation_angle():
    assert search.rotation_angle(6, 60) == pytest.approx(0.003 * np.pi)
    assert search.rotation_angle(10_000, 60) == pytest.approx(0.15 * np.pi)
    with pytest.raises(ValueError):
        search.rotation_angle(0, 1)


def test_generated_fleets(spark):
    ids = spark.range(30).withColumnRenamed("id", "index")
    for kind in ("coastal", "tug", "large"):
        df = fleet.generated_fleet(ids, kind)
        assert df.count() == 30 and fleet.validate_vessels(df).count() == 0
    assert fleet.generated_fleet(ids, "tug").where("design_efficiency_gco2_per_t_nmi is null").count() == 30
    with pytest.raises(ValueError):
        fleet.generated_fleet(ids, "space")
    tiny = spark.createDataFrame(fleet.TINY_VESSELS, fleet.VESSEL_COLUMNS)
    assert fleet.validate_vessels(tiny).count() == 0


def test_nearly_equal_plans_are_found_across_steps(spark):
    """The distance decides, wherever the values lie on the scale of steps."""
    import random

    from bunkerline.operators import pareto

    rng = random.Random(5)
    base = [(rng.uniform(1, 100), rng.uniform(-5, 5)) for _ in range(40)] + [(0.0, 0.0), (0.0, 1.0)]
    points = [(a * (1 + rng.choice([0, 0.4e-5, -0.9e-5, 2e-5])), b * (1 + rng.choice([0, 0.9e-5, 3e-5]))) for a, b in base for _ in range(4)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "k long, a double, b double")
    close = lambda x, y: abs(x - y) <= 1e-5 * max(abs(x), abs(y))
    want = {i for i, p in enumerate(points) if any(close(p[0], q[0]) and close(p[1], q[1]) for q in points[:i])}
    assert {r["k"] for r in pareto._nearly_equal(df, ["a", "b"], "k").collect()} == want


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_exploded_candidates_are_not_broadcast(spark, tmp_path):
    # Spark takes the options that an explode makes for as few bytes as the vessels they come from
    spark.createDataFrame([vessel(k) for k in range(4)], VESSEL).write.parquet(f"{tmp_path}/vessels")  # a table of known size
    fleets = spark.read.parquet(f"{tmp_path}/vessels").withColumn("instance", F.floor(F.col("vessel_key") / 2).cast("bigint"))
    out = fleet.exact_small(fleets, TINY, "instance")
    assert "Broadcast" not in planned(out)
    assert "Broadcast" not in planned(fleet.qubo_variables(fleets, TINY, "instance"))
    assert {r["instance"] for r in out.collect()} == {0, 1}


def test_nearest_distances_broadcast_nothing_that_grows(spark):
    rows = spark.range(400).select(F.col("id").alias("plan_id"), *[F.rand(i).alias(c) for i, c in enumerate(OBJ)]).localCheckpoint()
    assert "Broadcast" not in planned(pareto.nearest_distance(rows, rows, "plan_id", OBJ, skip_self=True))


def test_search_spreads_the_rows_of_one_split(spark, tmp_path, monkeypatch):
    spark.createDataFrame([vessel(k) for k in range(4)], VESSEL).coalesce(1).write.parquet(f"{tmp_path}/vessels")
    seen, observe = [], search._observe
    monkeypatch.setattr(search, "_observe", lambda state, *rest: seen.append(state.rdd.getNumPartitions()) or observe(state, *rest))
    search.search(spark.read.parquet(f"{tmp_path}/vessels"), COASTAL, individuals=2, generations=1)
    assert seen == [spark.sparkContext.defaultParallelism]


def test_greedy_scores_routes_in_the_row(spark):
    rows = [vessel(1), vessel(1), vessel(1, hours=300.0), vessel(2, cost=2e8)]  # repeated, and repeated with another value
    fleets = spark.createDataFrame(rows, VESSEL).withColumn("fleet", F.lit(0).cast("bigint"))
    out = fleet.greedy(fleets, COASTAL, "fleet")
    assert "[0,0,1]" not in planned(out)  # no triples of fraction, fuel and route are exploded
    assert out.groupBy("fraction", "fuel_idx", "vessel").count().where("count > 1").isEmpty()
    assert out.where("vessel = 'V1' and fuel_idx = 0 and fraction = 10").first()["delivered_t"] > 5e5


def test_strong_rows_of_groups_go_to_the_rows(spark):
    rows = spark.range(1000).selectExpr("cast(id % 3 as string) as _key", "cast(id as double) as a", "cast(-id as double) as b", "true as _own")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = planned(pareto._drop_beaten(rows, ["a", "b"], True))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan  # a shuffle by group is a task a group


def test_front_stream_meets_few_points_first(spark, monkeypatch):
    rng = np.random.default_rng(5)
    points = rng.integers(0, 60, (3000, 3)).astype(float)
    pdf = pd.DataFrame(points, columns=["a", "b", "c"]).sort_values(["a", "b", "c"], ignore_index=True)
    pdf = pdf.assign(_sum=pdf.sum(axis=1), _own=True, _key="").sort_values(["_sum", "a", "b", "c"], ignore_index=True)
    monkeypatch.setattr(pareto, "GUARDS", 4)
    out = pd.concat(pareto._front_stream(["a", "b", "c"], "_key")(pdf.iloc[i:i + 500] for i in range(0, 3000, 500)))
    unique = np.unique(points, axis=0)
    worse = ((unique[:, None] >= unique[None]).all(axis=2) & (unique[:, None] > unique[None]).any(axis=2)).any(axis=1)
    assert {tuple(v) for v in out[["a", "b", "c"]].to_numpy()} == {tuple(v) for v in unique[~worse]} and len(out) == (~worse).sum()


def test_scenarios_are_added_up_where_a_plans_vessels_are(spark):
    from bunkerline.plans import catalog  # noqa: F401  registers the queries
    from bunkerline.plans.registry import QUERIES

    names = VESSEL.replace("compatible_routes array<string>", "compatible_routes_text string").replace("compatible_fuels array<string>", "compatible_fuels_text string")
    views = {
        "v_vessel": spark.createDataFrame([vessel(k) for k in range(4)], names),
        "v_plan": spark.createDataFrame([(p, k, f"V{k}", k % 3, (p or 0) % 4, 10.0) for p in (1, 2, None) for k in range(4)],
                                        "plan_id long, vessel_key long, vessel string, route_idx int, fuel_idx int, speed_kn double")}
    for name in ("flt_scenario_sweep", "flt_scenario_prices"):
        out = QUERIES[name](SimpleNamespace(view=views.get))
        plan = planned(out)
        assert "hashpartitioning(plan_id" in plan and not re.search(r"hashpartitioning\(plan_id[^)]*scenario", plan)
        assert {(r["scenario"], r["n"]) for r in out.collect()} == {("coastal", 3), ("capped", 3), ("cheap_lng", 3)}


def test_nearest_distances_in_boxes_that_follow_a_front(spark, monkeypatch):
    """Objectives that fall with each other, ties and copies: boxes stay small, most targets meet one, and distances are exact."""
    monkeypatch.setattr(pareto, "CELL_POINTS", 20)
    monkeypatch.setattr(pareto, "TILE_ROWS", 15)
    rng = np.random.default_rng(4)
    a = rng.uniform(1, 100, 600)
    points = np.stack((a, 1000 / a + rng.normal(size=600) * 0.01, np.where(a < 50, 7.0, rng.integers(0, 3, 600))), axis=1)
    points[-20:] = points[:20]
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)] + [(600, 3.0, None, 1.0)], "id long, x double, y double, z double")
    got = {r["id"]: r["nearest"] for r in pareto.nearest_distance(df, df, "id", ["x", "y", "z"], skip_self=True).collect()}
    gaps = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2)) + np.diag(np.full(600, np.inf))
    assert got.pop(600) is None and [got[i] for i in range(600)] == pytest.approx(gaps.min(axis=1).tolist())
    known = df.where("y is not null").select("x", "y", "z").distinct()
    bins = 3
    cuts = pareto._nested_cuts(known, ["x", "y", "z"], bins)
    home = pareto._in_boxes(known, ["x", "y", "z"], cuts, bins)
    assert max(r["count"] for r in home.groupBy("_box").count().collect()) < 100 and home.count() == known.count()
    assert pareto._in_boxes(known, ["x", "y", "z"], cuts, bins, F.lit(0.01)).count() < 4 * known.count()  # of 27
