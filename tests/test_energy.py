import pytest
from pyspark.sql import functions as F

from bunkerline import dims
from bunkerline.operators import emissions, policy, ports, tank

TJ = 1_000_000.0
# one TJ of shaft work in 2030: fuel, pathway, WTT, CO2, CH4, N2O, pilot, total (tonnes)
GOLDEN = [
    ("mgo", "fossil", 32.0, 166.8488, 0.0775, 2.5571, 0.0, 201.4835),
    ("mgo", "bio", 35.5556, 0.0, 0.0775, 2.5571, 0.0, 38.1902),
    ("hfo", "fossil", 30.0, 172.1393, 0.0824, 2.7167, 0.0, 204.9383),
    ("lng", "fossil", 41.1111, 127.3148, 23.6744, 1.4487, 0.0, 193.5491),
    ("methanol", "e_fuel", 10.6667, 0.0, 0.0127, 0.3494, 8.0593, 19.0882),
    ("ammonia", "grey", 250.0667, 0.0, 0.0, 16.9260, 14.1038, 281.0965),
    ("ammonia", "green", 10.3333, 0.0, 0.0, 16.9260, 14.1038, 41.3632),
    ("hydrogen", "grey", 220.0, 0.0, 0.0, 0.0, 0.0, 220.0),
    ("electricity", "grid", 242.5160, 0.0, 0.0, 0.0, 0.0, 242.5160),
]


def rows(spark, data, columns="energy_mj double, fuel string, pathway string, engine string"):
    return spark.createDataFrame(data, columns).withColumn("grid_factor_t_per_mwh", ports.grid_factor(F.lit(2030)))


def test_golden_totals(spark):
    df = rows(spark, [(TJ, f, p if p != "grid" else None, None) for f, p, *_ in GOLDEN])
    got = {(r["fuel"], r["pathway"]): r for r in emissions.compute(df).collect()}
    for fuel, pathway, *want in GOLDEN:
        r = got[(fuel, pathway)]
        have = [r[c] for c in ("wtt_t", "co2_t", "ch4_t", "n2o_t", "pilot_t", "total_t")]
        assert have == pytest.approx(want, abs=6e-5)
        assert r["total_t"] == pytest.approx(sum(have[:5])) and r["emission_status"] == "ok"
    assert got[("lng", "fossil")]["confidence"] == "medium" and got[("electricity", "grid")]["confidence"] == "provisional"


def test_statuses_and_strict(spark):
    df = rows(spark, [(TJ, "ammonia", None, None), (TJ, "mgo", "purple", None), (TJ, "lng", "fossil", "steam"), (-1.0, "mgo", "fossil", None),
                      (TJ, "coal", None, None), (TJ, "hfo", None, "steam")])
    got = [r["emission_status"] for r in emissions.compute(df).collect()]
    assert sorted(got) == sorted(["pathway_needed", "unknown_pathway", "unknown_engine", "negative_energy", "unknown_fuel", "ok"])
    with pytest.raises(Exception, match="pathway_needed"):
        emissions.compute(df.where("fuel = 'ammonia'"), strict=True).collect()
    no_grid = emissions.compute(df.limit(0).unionByName(rows(spark, [(TJ, "electricity", None, None)])).drop("grid_factor_t_per_mwh"))
    assert no_grid.first()["emission_status"] == "grid_factor_needed"
    with pytest.raises(ValueError, match="GWP"):
        emissions.compute(df, gwp_set="nope")


def test_engine_gwp_and_pilot_switches(spark):
    df = rows(spark, [(TJ, "lng", "fossil", "otto_medium_speed")])
    low, high = emissions.compute(df).first(), emissions.compute(df, "eu_mrv_ar5").first()
    assert low["ch4_t"] / high["ch4_t"] == pytest.approx(29.8 / 28.0)
    assert low["ch4_t"] == pytest.approx(TJ / 0.45 / 48 / 1000 * 0.031 * 29.8)
    bare = emissions.compute(rows(spark, [(TJ, "methanol", "fossil", None)]), include_pilot=False).first()
    assert bare["pilot_t"] == 0.0 and bare["fuel_mass_t"] == pytest.approx(TJ / 0.45 / 19.9 / 1000)


def test_compare_orders_and_agrees_with_compute(spark):
    df = rows(spark, [(TJ, "x", None, None)]).withColumn("k", F.lit(1))
    ranked = emissions.compare(df, ["k"]).orderBy("place").collect()
    assert [r["total_t"] for r in ranked] == sorted(r["total_t"] for r in ranked) and len(ranked) == 10
    full = {(r["fuel"], r["pathway"]): r["total_t"] for r in emissions.compute(emissions.with_options(df)).collect()}
    for r in ranked:
        assert r["total_t"] == pytest.approx(full[(r["fuel"], r["pathway"])], rel=1e-12)


def test_grey_fuels_flip_the_verdict(spark):
    df = rows(spark, [(TJ, "x", None, None)])
    out = {(r["fuel"], r["pathway"]): r for r in emissions.stack_versus_lifecycle(emissions.with_options(df)).collect()}
    assert out[("ammonia", "grey")]["verdict_flips"] and not out[("ammonia", "green")]["verdict_flips"]
    assert out[("ammonia", "grey")]["relative_change"] == pytest.approx(0.395, abs=1e-3)
    assert out[("mgo", "fossil")]["relative_change"] == pytest.approx(0.0, abs=1e-12)


def test_local_pollutants(spark):
    r = {x["fuel"]: x for x in emissions.local_pollutants(rows(spark, [(TJ, "mgo", None, None), (TJ, "ammonia", None, None), (TJ, "electricity", None, None)])).collect()}
    mass = TJ / 0.45 / 42.7 / 1000
    assert r["mgo"]["nox_kg"] == pytest.approx(mass * 57) and r["electricity"]["nox_kg"] == 0.0
    assert r["ammonia"]["sox_kg"] == pytest.approx(0.07 * mass * 2.0)


def test_availability_steps(spark):
    cases = [("cochin", "lng", 2020, "none"), ("cochin", "lng", 2024, "limited"), ("cochin", "lng", 2035, "available"), ("mumbai", "hfo", 2050, "limited"),
             ("mumbai", "coal", 2030, "none"), ("mormugao", "lng", 2030, "planned")]
    df = spark.createDataFrame([c[:3] for c in cases], "port string, fuel string, year int")
    got = {(r["port"], r["fuel"], r["year"]): r["availability"] for r in ports.can_bunker(df).collect()}
    assert got == {c[:3]: c[3] for c in cases}
    usable = {(r["port"], r["fuel"], r["year"]): r["can_bunker"] for r in ports.can_bunker(df).collect()}
    assert not usable[("mormugao", "lng", 2030)] and usable[("mumbai", "hfo", 2050)]


def test_routes(spark):
    df = spark.createDataFrame([(["mumbai", "cochin"], "lng", 2030), (["mumbai", "mormugao"], "lng", 2030)], "ports array<string>, fuel string, year int")
    good, bad = ports.route_status(df).collect()
    assert good["route_feasible"] and good["blocking_reason"] is None
    assert bad["blocking_ports"] == ["mormugao (planned)"] and "mumbai > mormugao" in bad["blocking_reason"]
    assert ports.fuels_on_route(df).collect()[1]["route_fuels"] == ["electricity", "hfo", "mgo"]
    with pytest.raises(Exception, match="at least one port"):
        ports.route_status(df.withColumn("ports", F.array().cast("array<string>"))).collect()


def test_earliest_grid_and_crossover(spark):
    first = {(r["port"], r["fuel"]): r["earliest_year"] for r in ports.earliest_years(spark).collect()}
    assert first[("cochin", "lng")] == 2024 and first[("mumbai", "methanol")] == 2047 and first[("mumbai", "hydrogen")] is None
    years = spark.createDataFrame([(y,) for y in (2010, 2024, 2033, 2060)], "y int")
    got = [r[0] for r in years.select(ports.grid_factor(F.col("y"))).collect()]
    assert got == pytest.approx([0.716 / 0.83, 0.855422, 0.636145, 0.240964], rel=1e-5)
    assert ports.crossover(spark.createDataFrame([(TJ,)], "energy_mj double")).first()["crossover_year"] == 2035


def test_shore_power_needs_both(spark):
    df = spark.createDataFrame([("jnpa", 2030, TJ, True), ("jnpa", 2030, TJ, False), ("cochin", 2025, TJ, True), ("cochin", 2025, TJ, False)],
                               "port string, year int, energy_mj double, vessel_equipped boolean")
    rows_ = ports.shore_power(df).collect()
    assert [r["available"] for r in rows_] == [True, False, False, False]
    assert rows_[0]["saving_t"] == pytest.approx(201.4835 - 242.5160, abs=1e-3) and rows_[3]["saving_t"] == 0.0
    assert rows_[3]["reason"].startswith("neither")


def test_tank(spark):
    df = spark.createDataFrame([("hydrogen", 5000.0, 3000.0), ("mgo", 5000.0, 3000.0)], "fuel string, route_nmi double, energy_per_nmi_mj double")
    retrofit = {r["fuel"]: r for r in tank.assess(df).collect()}
    assert retrofit["mgo"]["feasible"] and not retrofit["hydrogen"]["feasible"] and "short" in retrofit["hydrogen"]["reason"]
    newbuild = {r["fuel"]: r for r in tank.assess(df, size_tank_for="fuel").collect()}
    assert newbuild["hydrogen"]["feasible"] and newbuild["hydrogen"]["cargo_displaced_t"] > 0
    assert newbuild["mgo"]["cargo_displaced_t"] == 0.0
    assert newbuild["hydrogen"]["range_nmi"] == pytest.approx(5000.0)


def test_policy(spark):
    df = spark.createDataFrame([(y,) for y in (2020, 2023, 2030, 2047, 2060)], "y int")
    assert [r[0] for r in df.select(policy.required_reduction(F.col("y"))).collect()] == pytest.approx([0, 0, 0.3, 0.7, 0.7])
    status = policy.assess(spark.createDataFrame([(2030, 70.0, 100.0, 1.0), (2030, 80.0, 100.0, 1.0), (2030, 1.0, 0.0, 1.0)],
                                                 "year int, emissions_t double, cargo_t double, baseline_intensity double")).collect()
    assert status[0]["on_track"] and status[0]["gap"] == 0.0
    assert not status[1]["on_track"] and status[1]["gap"] == pytest.approx(0.1)
    assert status[2]["on_track"] is None


def test_reference_rows(spark):
    assert dims.availability(spark).count() == 168 and dims.fuels(spark).count() == 7
