import json
import math
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bunkerline import dims, reference as ref
from bunkerline.functions import units
from bunkerline.operators import derive, features, learning, model, physics, splits, stats
from bunkerline.sources import filings, panel_store, sinks
from bunkerline.streaming.upsert import merge_drop, upsert_stream

HEADERS = ["IMO Number", "Ship type", "Reporting Period", "Total fuel consumption [m tonnes]",
           "Total CO₂ emissions [m tonnes]", "Time spent at sea [hours]",
           "Fuel consumption per distance [kg / n mile]"]


def test_headers_fold_and_resolve():
    assert filings.fold_header("  Total CO₂  emissions [m tonnes · x] – y") == "total co2 emissions [m tonnes . x] - y"
    found = filings.resolve_headers([*reversed(HEADERS), "Verifier"])
    assert found.source["time_at_sea_h"] == "Time spent at sea [hours]"
    assert set(found.via_alias) == {"time_at_sea_h", "fuel_per_distance_kg_per_nmi"}
    assert found.unconsumed == ("Verifier",) and "laden_fuel_t" in found.missing_optional
    with pytest.raises(filings.FilingSchemaError, match="imo"):
        filings.resolve_headers(HEADERS[1:])


def text_rows(spark, rows):
    base = dict(source_file="filings_2021.csv", report_coverage="full", file_version="1", ship_type="Bulk carrier",
                reporting_period="2021", total_co2_t="311.4", time_at_sea_h="100", fuel_per_distance_kg_per_nmi="50")
    full = [{**base, **r} for r in rows]
    names = sorted({k for r in full for k in r})
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in full], ", ".join(f"{n} string" for n in names))


def test_dedup_prefers_complete_then_last(spark):
    rows = text_rows(spark, [
        dict(file_order="1", imo="7", total_fuel_t="100", ice_class="IA"),
        dict(file_order="2", imo="7", total_fuel_t="200"),
        dict(file_order="3", imo="8", total_fuel_t="300"),
        dict(file_order="4", imo="8", total_fuel_t="400"),
        dict(file_order="5", imo="9", total_fuel_t="N/A"),
        dict(file_order="6", imo="x", total_fuel_t="1"),
        dict(file_order="7", imo="10", total_fuel_t="5", report_coverage="partial"),
        dict(file_order="8", imo="11", total_fuel_t="6", reporting_period=None),
    ])
    got = {(r["imo"], r["reporting_period"]): r["total_fuel_t"] for r in filings.build_panel(rows).collect()}
    assert got == {(7, 2021): 100.0, (8, 2021): 400.0, (11, 2021): 6.0}


def test_scan_reads_text_in_file_order(spark, tmp_path):
    path = tmp_path / "filings_2020.csv"
    path.write_text(",".join(f'"{h}"' for h in HEADERS) + "\n" + "\n".join(
        f'{i},Bulk carrier,,"1,{i:03d}",10,100,5' for i in range(20)))
    raw = filings.scan_period(spark, str(path))
    text = filings.apply_headers(raw, ["source_file", "file_order"])
    typed = filings.typed_filings(text).orderBy("file_order").collect()
    assert [r["imo"] for r in typed] == list(range(20))
    assert typed[3]["total_fuel_t"] == 1003.0 and typed[3]["reporting_period"] == 2020
    manifest = filings.input_manifest(spark, str(tmp_path), "*.csv").first()
    assert manifest["reporting_period"] == 2020 and not manifest["is_workbook"] and len(manifest["sha256"]) == 64


@pytest.fixture(scope="module")
def one_row(spark):
    def build(**over):
        row = dict(total_fuel_t=100.0, total_co2_t=311.4, time_at_sea_h=200.0, fuel_per_distance_kg_per_nmi=50.0,
                   fuel_per_work_mass_g_per_t_nmi=None, fuel_per_work_dwt_g_per_dwt_nmi=5.0, co2_at_berth_t=31.14, laden_fuel_t=None,
                   time_at_sea_ice_h=None, technical_efficiency_raw="eiv ( 45.57 gCO2/t.nm)", ice_class=None)
        row.update(over)
        kinds = {k: "string" if k in ("technical_efficiency_raw", "ice_class") else "double" for k in row}
        df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {t}" for k, t in kinds.items()))
        return derive.derive_physics(df).first()
    return build


def test_derived_values(one_row):
    r = one_row()
    assert (r["distance_nmi"], r["mean_speed_kn"]) == (2000.0, 10.0)
    assert (r["cargo_carried_t"], r["cargo_basis"]) == (10000.0, "dwt")
    assert r["inferred_lhv_mj_per_kg"] == pytest.approx(40.2)
    assert r["mean_power_kw"] == pytest.approx(100 * 1000 * 40.2 / 200 / 3.6)
    assert r["berth_co2_share"] == pytest.approx(0.1) and r["laden_fuel_share"] is None and r["ice_time_share"] == 0.0
    assert (r["technical_efficiency_metric"], r["technical_efficiency_gco2_per_t_nmi"]) == ("EIV", 45.57)
    assert r["is_usable"] and not r["has_ice_class"]


@pytest.mark.parametrize("over, flag", [
    (dict(total_co2_t=968.0), "flag_implied_cf_t_per_t_implausible"),
    (dict(time_at_sea_h=20.0), "flag_mean_speed_kn_implausible"),
    (dict(time_at_sea_h=9000.0), "flag_time_at_sea_h_implausible"),
    (dict(total_fuel_t=0.0), "flag_zero_fuel_while_sailing"),
    (dict(total_fuel_t=-1.0), "flag_negative_fuel"),
])
def test_flags(one_row, over, flag):
    r = one_row(**over)
    assert r[flag] and not r["is_usable"]


def test_missing_values_never_flag(one_row):
    r = one_row(fuel_per_distance_kg_per_nmi=None, fuel_per_work_dwt_g_per_dwt_nmi=None)
    assert not any(r[f] for f in derive.BOUND_FLAGS) and not r["is_usable"] and r["cargo_basis"] == "none"


@pytest.mark.parametrize("cf, lhv", [(3.206, 42.7), (3.114, 40.2), (2.75, 48.0), (2.0, 48.0), (3.5, 42.7)])
def test_blend_endpoints(spark, cf, lhv):
    df = spark.range(1).select(derive.blend(F.lit(cf))[0].alias("l"))
    assert df.first()["l"] == pytest.approx(lhv)


def test_features_and_guard(spark):
    df = spark.createDataFrame(
        [(" BULKER ", 2020, 5.0, "IA", 100.0, "EEDI"), ("Hovercraft", 2020, -1.0, "Not Applicable", 1.0, None), (None, 2020, None, None, 1.0, None)],
        "ship_type string, reporting_period int, technical_efficiency_gco2_per_t_nmi double, ice_class string, time_at_sea_h double, technical_efficiency_metric string")
    rows = features.build_features(df).collect()
    assert [r["vessel_class"] for r in rows] == ["bulk_carrier", "other", "other"]
    assert [(r["has_ice_class"], r["ice_class_ordinal"]) for r in rows] == [(1, 3.0), (1, 0.0), (0, 0.0)]
    assert [r["has_design_efficiency"] for r in rows] == [1, 0, 0] and rows[0]["efficiency_metric_eedi"] == 1
    hot = features.one_hot_classes(features.build_features(df)).first()
    assert sum(hot[c] for c in features.class_columns()) == 1 and len(features.class_columns()) == 19
    with pytest.raises(features.ContaminatedFeatureError):
        features.build_features(df, extra=["mean_speed_kn"])
    assert [r[0] for r in features.unknown_labels(df).collect()] == ["Hovercraft"]


@pytest.fixture(scope="module")
def ship_years(spark):
    return spark.range(200).select((F.col("id") + 9000).alias("imo"), F.explode(F.sequence(F.lit(2018), F.lit(2025))).alias("reporting_period"))


def test_splits_keep_ships_whole(ship_years):
    out = splits.split_by_vessel(ship_years, 0.25, 7)
    sizes = {r["split"]: (r["rows"], r["ships"]) for r in splits.summary(out).collect()}
    assert sizes == {"test": (400, 50), "train": (1200, 150)}
    splits.assert_no_leakage(out)
    assert splits.leakage(splits.split_by_time(ship_years, 2021)).count() == 200
    strict = splits.split_by_vessel_and_time(ship_years, 2021, 0.25, 7)
    assert {r["split"]: r["rows"] for r in splits.summary(strict).collect()} == {"train": 600, "test": 200}
    with pytest.raises(ValueError, match="both sides"):
        splits.assert_no_leakage(splits.split_by_time(ship_years, 2021))
    with pytest.raises(ValueError, match="empty side"):
        splits.split_by_time(ship_years, 2030)


def test_folds_cover_every_row_once(ship_years):
    out = splits.grouped_folds(ship_years, 5)
    assert out.count() == 1600
    assert {r["fold"]: r["count"] for r in out.groupBy("fold").count().collect()} == dict.fromkeys(range(5), 320)
    assert splits.leakage(out, side="fold").count() == 0


def test_split_needs_two_ships(spark):
    with pytest.raises(Exception, match="two ships"):
        splits.split_by_vessel(spark.createDataFrame([(1, 2020)], "imo long, reporting_period int")).collect()


def test_physics_fit_matches_least_squares(spark):
    rng = np.random.default_rng(3)
    n = 300
    pdf = pd.DataFrame({"ship_type": np.where(np.arange(n) < 280, "A", "B"), "cargo_carried_t": rng.uniform(1e3, 1e5, n),
                        "mean_speed_kn": rng.uniform(8, 20, n)})
    pdf["mean_power_kw"] = 0.3 * pdf.cargo_carried_t**0.6 * pdf.mean_speed_kn**2.5 * rng.lognormal(0, 0.1, n)
    df = spark.createDataFrame(pdf)
    got = {r["ship_type"]: r for r in physics.fit(df).collect()}
    part = pdf[pdf.ship_type == "A"]
    x = np.column_stack([np.ones(len(part)), np.log(part.cargo_carried_t), np.log(part.mean_speed_kn)])
    want = np.linalg.lstsq(x, np.log(part.mean_power_kw), rcond=None)[0]
    a = got["A"]
    np.testing.assert_allclose([a["intercept"], a["displacement_exponent"], a["speed_exponent"]], want, rtol=1e-8)
    assert got["B"]["pooled"] and got["B"]["speed_exponent"] == got["__pooled__"]["speed_exponent"]
    scored = physics.predict(df.withColumn("ship_type", F.lit("C")), physics.fit(df)).first()
    assert scored["cold_start"] and scored["predicted_power_kw"] > 0


def test_ridge_matches_closed_form(spark):
    rng = np.random.default_rng(4)
    n = 200
    pdf = pd.DataFrame({
        "vessel_class": rng.choice(["bulk_carrier", "other"], n), "design_efficiency_gco2_per_t_nmi": rng.uniform(5, 30, n),
        "has_design_efficiency": 1, "efficiency_metric_eiv": rng.integers(0, 2, n), "efficiency_metric_eedi": 0, "efficiency_metric_eexi": 0,
        "has_ice_class": 0, "ice_class_ordinal": 0.0, "ice_time_share": rng.random(n), "reporting_period": rng.integers(2018, 2026, n).astype(float),
        "time_at_sea_h": rng.uniform(10, 60, n)})
    pdf["target"] = np.exp(5 - 0.03 * pdf.design_efficiency_gco2_per_t_nmi + 0.3 * (pdf.vessel_class == "other") + rng.normal(0, 0.1, n))
    df = spark.createDataFrame(pdf)
    got = np.array([r["log_level"] for r in learning.fit_ridge(df)(df).select("log_level").collect()])
    x = pdf[learning.NUMERIC].to_numpy(dtype=float)
    hot = np.column_stack([(pdf.vessel_class == c[6:]).to_numpy(dtype=float) for c in features.class_columns()])
    x = np.column_stack([x, hot])
    xc, y = x - x.mean(0), np.log(pdf.target).to_numpy()
    w = np.linalg.solve(xc.T @ xc + np.eye(x.shape[1]), xc.T @ (y - y.mean()))
    np.testing.assert_allclose(got, y.mean() + xc @ w, rtol=1e-6)


def test_monotone_envelope_never_rises(spark):
    def bumpy(df):
        return df.withColumn("log_level", F.sin(F.coalesce(F.col(learning.DESIGN), F.lit(0.0))))

    df = spark.range(60).select("id", F.when(F.col("id") < 55, F.col("id") / 5.0).alias(learning.DESIGN))
    out = {r["id"]: r["log_level"] for r in learning.monotone_scores(bumpy, df, [0.0, 2.0, 4.0, 6.0, 8.0, 10.0], ["id"]).collect()}
    assert len(out) == 60
    series = [out[i] for i in range(55)]
    assert all(b <= a + 1e-12 for a, b in zip(series, series[1:]))


def test_speed_law(spark):
    df = spark.createDataFrame([("bulk_carrier", 1000.0, 9.0, False)], "vessel_class string, intensity double, design_efficiency_gco2_per_t_nmi double, unseen_class boolean")
    checked = model.check_zero_speed(model.check_monotone_speed(df)).first()
    assert checked["falls"] == 0 and checked["rest_ok"]
    assert checked["rest_power_kw"] == pytest.approx(1000 * 14 / 3.6 * 0.06)
    best = df.select(model.optimal_speed(F.lit(14.0), F.lit(0.06), F.lit(1.0))).first()[0]
    at = lambda v: (0.94 * (v / 14) ** 2 + 0.06 * 14 / v)
    assert at(best) <= min(at(best * 0.99), at(best * 1.01))


def test_bands_need_rows(spark):
    few = spark.createDataFrame([("a", float(i), False) for i in range(10)], "vessel_class string, residual double, cold_start boolean")
    rows = stats.residual_bands(few).collect()
    assert [(r["scope"], r["low"], r["high"]) for r in rows] == [("global", -0.3, 0.3)]


def test_units(spark):
    df = spark.createDataFrame([(2.0, "[GJ]", "energy"), (1.0, "MT", "mass"), (1.0, "m³", "volume"), (1.0, "Kn", "speed")], "value double, unit string, dimension string")
    got = [(r["canonical_value"], r["unit_status"]) for r in units.to_canonical(df).collect()]
    assert got == [(2000.0, "ok"), (None, "ambiguous"), (1.0, "ok"), (None, "unknown")]
    with pytest.raises(Exception, match="unit"):
        units.to_canonical(df, strict=True).collect()
    ms = spark.range(1).select(units.kn_to_ms(F.lit(10.0)).alias("a"), units.convert(F.lit(10.0), "kn", "m/s", "speed").alias("b")).first()
    assert ms["a"] == ms["b"] == pytest.approx(5.1444, rel=1e-4)


def test_dims_are_consistent(spark):
    args = [dims.TABLES[n](spark) for n in ("fuels", "pathways", "pilots", "slips", "class_aliases", "gwp_sets")]
    assert dims.violations(*args, ref.DEFAULT_GWP_SET).count() == 0
    broken = args[0].withColumn("lhv", F.when(F.col("fuel") != "mgo", F.col("lhv")))
    found = dims.violations(broken, *args[1:], "nope").collect()
    assert {(r["rule"], r["subject"]) for r in found} == {("combustible_without_lhv", "mgo"), ("gwp_set_missing", "nope")}
    assert "dim_fuels" in dims.register_views(spark) and spark.table("dim_fuels").count() == 7


def test_model_card_carries_settings_and_metrics(spark):
    rows = spark.createDataFrame([(1, 2019), (1, 2020), (2, 2019)], "imo bigint, reporting_period int")
    found = json.loads(sinks.model_card(rows, {"trees": 4}, spark.createDataFrame([(3, 12.5)], "n int, mape double")).first()["card"])
    assert (found["n_rows"], found["n_ships"], found["periods"]) == (3, 2, "2019,2020")
    assert json.loads(found["params"]) == {"trees": 4} and found["held_out"] == {"n": 3, "mape": 12.5}
    assert "held_out" not in json.loads(sinks.model_card(rows).first()["card"])


def test_digest_ignores_column_order(spark):
    df = spark.createDataFrame([(1, "x")], "b int, a string")
    one = sinks.run_context(df, 1, "s").first()["input_digest"]
    assert one == sinks.run_context(df.select("a", "b"), 1, "s").first()["input_digest"] and len(one) == 16


def test_stream_upsert(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "panel"
    source.mkdir()
    names = ["file_order", "source_file", "report_coverage", "file_version", "imo", "ship_type", "reporting_period", "total_fuel_t",
             "total_co2_t", "time_at_sea_h", "fuel_per_distance_kg_per_nmi"]

    def drop(name, version, fuel):
        (source / name).write_text(",".join(names) + "\n" + f"1,{name},full,{version},7,Bulk carrier,2021,{fuel},300,100,50\n")

    def run():
        upsert_stream(spark, str(source), ", ".join(f"{n} string" for n in names), str(target), str(tmp_path / "cp")).awaitTermination()
        return [(r["imo"], r["total_fuel_t"], r["file_version"]) for r in panel_store.read_panel(spark, str(target)).collect()]

    drop("filings_2021_v1.csv", 1, 100)
    assert run() == [(7, 100.0, 1)]
    drop("filings_2021_v2.csv", 2, 120)
    assert run() == [(7, 120.0, 2)]
    batch = spark.read.option("header", True).csv(str(source / "filings_2021_v1.csv"))
    merge_drop(batch, str(target))  # a late, older version changes nothing
    assert [(r["total_fuel_t"]) for r in panel_store.read_panel(spark, str(target)).collect()] == [120.0]


def test_level_models_are_interchangeable(spark):
    rows = [("bulk_carrier", 10.0, 100.0), ("bulk_carrier", 12.0, 400.0), ("other", 11.0, 50.0)]
    df = spark.createDataFrame(rows, "vessel_class string, design_efficiency_gco2_per_t_nmi double, target double")
    score = learning.fit_level("class_mean", df)
    got = score(spark.createDataFrame([("bulk_carrier", 1.0), ("ropax", 1.0)], "vessel_class string, design_efficiency_gco2_per_t_nmi double")).collect()
    assert math.exp(got[0]["log_level"]) == pytest.approx(200.0)
    assert math.exp(got[1]["log_level"]) == pytest.approx((100 * 400 * 50) ** (1 / 3))
    with pytest.raises(ValueError):
        learning.fit_level("forest", df)


def test_manifest_reads_in_chunks(spark, tmp_path, monkeypatch):
    import hashlib

    monkeypatch.setattr(filings, "CHUNK_BYTES", 10)  # a worker may keep its own
    (tmp_path / "2021_v3.xlsx").write_bytes(b"PK\x03\x04" + b"x" * 95)
    (tmp_path / "2022.xlsx").write_bytes(b"x")
    got = {r["file_name"]: r for r in filings.input_manifest(spark, str(tmp_path)).collect()}
    first, second = got["2021_v3.xlsx"], got["2022.xlsx"]
    assert first["sha256"] == hashlib.sha256(b"PK\x03\x04" + b"x" * 95).hexdigest() and first["is_workbook"] and first["version"] == 3
    assert second["sha256"] == hashlib.sha256(b"x").hexdigest() and not second["is_workbook"]


def test_rewritten_inputs_are_read_again(spark, small_dir, tmp_path):
    """A stored panel belongs to the files it was built from, also if they are replaced in place."""
    import shutil

    import pyarrow.parquet as pq

    import __spark_entry__ as entry

    for name in os.listdir(small_dir):
        if os.path.isfile(f"{small_dir}/{name}"):
            shutil.copy(f"{small_dir}/{name}", f"{tmp_path}/{name}")
            os.chmod(f"{tmp_path}/{name}", 0o644)
    total = lambda: sum(r["rows"] for r in entry.queries()["sink_parquet_panel"](spark, str(tmp_path)).collect())
    before = total()
    rows = pq.read_table(f"{small_dir}/lineitem.parquet")
    pq.write_table(rows.slice(0, rows.num_rows // 2), f"{tmp_path}/lineitem.parquet")
    assert total() < before


def test_dedup_sorts_rows_after_they_are_dealt_out(spark):
    rows = spark.createDataFrame([(1, 2020, "a", "x"), (1, 2020, "b", "x")], "imo long, reporting_period int, file_order string, ship_type string")
    out = filings.deduplicate(rows)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.rindex("Exchange") > plan.rindex("Sort ")  # deeper nodes come later
    assert [r["file_order"] for r in out.collect()] == ["b"]


def test_newest_versions_go_to_the_rows(spark):
    rows = spark.createDataFrame([(2020, 1, "a"), (2020, 2, "b"), (None, 3, "c"), (2021, 1, "d")], "reporting_period int, file_version int, v string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = filings.latest_version(rows)
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan  # a shuffle by period is a task a period
    assert sorted(r["v"] for r in out.collect()) == ["b", "d"]
