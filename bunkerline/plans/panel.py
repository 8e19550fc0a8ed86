"""Queries over features, splits, statistics and model scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bunkerline import reference as ref
from bunkerline.functions.expr import md5_uniform, rnd
from bunkerline.operators import features, fleet, model, physics, splits, stats
from bunkerline.plans.registry import Inputs, cte, query
from bunkerline.session import cut_lineage

KEY = ["imo", "reporting_period"]

cte("o_feat", """
SELECT u.imo, u.reporting_period AS period, COALESCE(a.vessel_class, 'other') AS vessel_class,
  CASE WHEN design > 0 THEN design END AS design, CAST(COALESCE(design > 0, FALSE) AS INTEGER) AS has_design,
  CAST(COALESCE(metric = 'EIV', FALSE) AS INTEGER) AS eiv, CAST(COALESCE(metric = 'EEDI', FALSE) AS INTEGER) AS eedi,
  CAST(COALESCE(metric = 'EEXI', FALSE) AS INTEGER) AS eexi, CAST(ice_class IS NOT NULL AS INTEGER) AS has_ice,
  CASE upper(trim(ice_class)) WHEN 'IA' THEN 3e0 WHEN 'PC7' THEN 5e0 ELSE 0e0 END AS ice_ordinal,
  COALESCE(CASE WHEN time_at_sea_h > 0 THEN COALESCE(time_at_sea_ice_h, 0e0) / time_at_sea_h END, 0e0) AS ice_share,
  CAST(u.reporting_period AS DOUBLE) AS period_d, time_at_sea_h, mean_speed_kn,
  inferred_lhv_mj_per_kg * fuel_per_distance_kg_per_nmi AS target
FROM o_usable u LEFT JOIN o_alias a ON a.label = lower(trim(u.ship_type))""")


def featured(t: Inputs) -> DataFrame:
    """Usable rows as model inputs with the target alongside."""
    rows = features.with_target(t.usable)
    return features.build_features(rows, keep=["imo", F.col("reporting_period").alias("period"), "mean_speed_kn", "target"])


@query("ftr_target", "SELECT imo, period AS reporting_period, round(target, 6) + 0e0 AS target FROM o_feat")
def _(t: Inputs):
    return features.with_target(t.usable).select(*KEY, rnd("target", 6).alias("target"))


@query("ftr_build", """
SELECT imo, vessel_class, design AS design_efficiency_gco2_per_t_nmi, has_design AS has_design_efficiency, eiv AS efficiency_metric_eiv, eedi AS efficiency_metric_eedi,
  eexi AS efficiency_metric_eexi, has_ice AS has_ice_class, ice_ordinal AS ice_class_ordinal, round(ice_share, 9) + 0e0 AS ice_time_share, period_d AS reporting_period, time_at_sea_h FROM o_feat""")
def _(t: Inputs):
    return features.build_features(t.usable, keep=["imo"]).withColumn("ice_time_share", rnd("ice_time_share", 9))


@query("ftr_contamination_guard", """
SELECT v.c AS "column", CASE v.c WHEN 'mean_speed_kn' THEN s WHEN 'distance_nmi' THEN d WHEN 'total_fuel_t' THEN f WHEN 'cargo_carried_t' THEN g END AS filled FROM (
  SELECT count(mean_speed_kn) AS s, count(distance_nmi) AS d, count(total_fuel_t) AS f, count(cargo_carried_t) AS g FROM o_derived)
CROSS JOIN (VALUES ('mean_speed_kn'), ('distance_nmi'), ('total_fuel_t'), ('cargo_carried_t')) v(c)""")
def _(t: Inputs):
    asked = ["mean_speed_kn", "distance_nmi", "total_fuel_t", "cargo_carried_t", "laden_fuel_share", "berth_co2_share"]
    leaking = features.contaminated(asked)
    counts = t.stored.agg(*[F.count(c).alias(c) for c in leaking])
    return counts.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("filled")) for c in leaking
    ])).alias("r")).select("r.*")


@query("ftr_one_hot", "SELECT imo, period AS reporting_period, " + ", ".join(
    f"CAST(vessel_class = '{c}' AS INTEGER) AS class_{c}" for c in sorted(c[0] for c in ref.CLASSES)) + " FROM o_feat")
def _(t: Inputs):
    rows = features.resolve_class(t.usable).select(*KEY, "vessel_class")
    return features.one_hot_classes(rows)


cte("o_vsplit", """
SELECT imo, CASE WHEN row_number() OVER (ORDER BY md5('1000-' || CAST(imo AS VARCHAR)), imo) <= ceil(0.25e0 * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split
FROM (SELECT DISTINCT imo FROM o_usable)""")


@query("spl_by_vessel", "SELECT u.imo, u.reporting_period, s.split FROM o_usable u JOIN o_vsplit s ON s.imo = u.imo")
def _(t: Inputs):
    return splits.split_by_vessel(t.usable.select(*KEY)).select(*KEY, "split")


@query("spl_by_time", "SELECT imo, reporting_period, CASE WHEN reporting_period <= 2021 THEN 'train' ELSE 'test' END AS split FROM o_usable")
def _(t: Inputs):
    return splits.split_by_time(t.usable.select(*KEY), 2021)


@query("spl_vessel_time", """
SELECT u.imo, u.reporting_period, s.split FROM o_usable u JOIN o_vsplit s ON s.imo = u.imo
WHERE (s.split = 'train' AND reporting_period <= 2021) OR (s.split = 'test' AND reporting_period > 2021)""")
def _(t: Inputs):
    return splits.split_by_vessel_and_time(t.usable.select(*KEY), 2021).select(*KEY, "split")


@query("spl_group_kfold", """
SELECT u.imo, u.reporting_period, f.fold FROM o_usable u JOIN (
  SELECT imo, CAST(CASE WHEN (place // 5) % 2 = 0 THEN place % 5 ELSE 4 - place % 5 END AS INTEGER) AS fold FROM (
    SELECT imo, row_number() OVER (ORDER BY count(*) DESC, md5('1000-' || CAST(imo AS VARCHAR)), imo) - 1 AS place FROM o_usable GROUP BY imo)) f ON f.imo = u.imo""")
def _(t: Inputs):
    return splits.grouped_folds(t.usable.select(*KEY), 5).select(*KEY, "fold")


@query("spl_leakage_check", "SELECT imo FROM o_usable GROUP BY imo HAVING min(reporting_period) <= 2021 AND max(reporting_period) > 2021")
def _(t: Inputs):
    return splits.leakage(splits.split_by_time(t.usable.select(*KEY), 2021))


@query("spl_summary", """SELECT s.split, count(*) AS "rows", count(DISTINCT u.imo) AS ships FROM o_usable u JOIN o_vsplit s ON s.imo = u.imo GROUP BY s.split""")
def _(t: Inputs):
    return splits.summary(splits.split_by_vessel(t.usable.select(*KEY)))


# --------------------------------------------------------------------------- statistics
METRICS = """count(*) AS n, round(avg(abs(e)), 8) + 0e0 AS mae, round(sqrt(avg(e * e)), 8) + 0e0 AS rmse, round(avg(abs(e) / actual) * 100e0, 8) + 0e0 AS mape,
  round(1e0 - sum(e * e) / (var_pop(actual) * count(*)), 8) + 0e0 AS r2, round(avg(e), 8) + 0e0 AS bias, round(quantile_cont(abs(e) / actual * 100e0, 0.5), 8) + 0e0 AS median_ape"""
cte("o_pairs", "SELECT *, predicted - actual AS e FROM v_prediction WHERE predicted IS NOT NULL AND actual > 0")
METRIC_COLUMNS = ("mae", "rmse", "mape", "r2", "bias", "median_ape")


@query("agg_regression_metrics", f"SELECT {METRICS} FROM o_pairs")
def _(t: Inputs):
    return stats.regression_metrics(t.view("v_prediction")).select("n", *[rnd(c, 8).alias(c) for c in METRIC_COLUMNS])


@query("agg_metrics_by_group", f"""
SELECT CASE WHEN grouping(grp) = 1 THEN '__overall__' ELSE grp END AS "group", {METRICS}, grouping(grp) = 1 OR count(*) >= 30 AS reliable FROM o_pairs GROUP BY GROUPING SETS ((grp), ())""")
def _(t: Inputs):
    out = stats.metrics_by_group(t.view("v_prediction"), "grp")
    return out.select("group", "n", *[rnd(c, 8).alias(c) for c in METRIC_COLUMNS], "reliable")


@query("agg_interval_metrics", """
SELECT count(*) AS n, 0.8e0 AS nominal_coverage, round(avg(CASE WHEN actual >= p10 AND actual <= p90 THEN 1e0 ELSE 0e0 END), 9) + 0e0 AS empirical_coverage,
  round(avg(CASE WHEN actual >= p10 AND actual <= p90 THEN 1e0 ELSE 0e0 END) - 0.8e0, 9) + 0e0 AS coverage_error, round(avg((p90 - p10) / actual), 9) + 0e0 AS mean_relative_width,
  round(avg(CASE WHEN actual < p10 THEN 1e0 ELSE 0e0 END), 9) + 0e0 AS below_p10, round(avg(CASE WHEN actual > p90 THEN 1e0 ELSE 0e0 END), 9) + 0e0 AS above_p90
FROM v_prediction WHERE actual > 0 AND p10 IS NOT NULL AND p90 IS NOT NULL""")
def _(t: Inputs):
    out = stats.interval_metrics(t.view("v_prediction"))
    return out.select("n", "nominal_coverage", *[rnd(c, 9).alias(c) for c in ("empirical_coverage", "coverage_error", "mean_relative_width", "below_p10", "above_p90")])


cte("o_level", "SELECT vessel_class, grouping(vessel_class) AS is_global, avg(ln(target)) AS log_level, count(*) AS n FROM o_feat GROUP BY GROUPING SETS ((vessel_class), ())")


@query("agg_class_level", "SELECT COALESCE(vessel_class, '__all__') AS vessel_class, round(log_level, 9) + 0e0 AS log_level, n FROM o_level")
def _(t: Inputs):
    out = stats.class_levels(featured(t))
    return out.select(F.coalesce("vessel_class", F.lit("__all__")).alias("vessel_class"), rnd("log_level", 9).alias("log_level"), "n")


cte("o_resid", """
SELECT f.*, ln(f.target) - l.log_level AS residual, f.design IS NULL AS cold FROM o_feat f JOIN o_level l ON l.vessel_class = f.vessel_class AND l.is_global = 0""")
cte("o_band", """
SELECT 'global' AS scope, NULL AS vessel_class, quantile_cont(residual, 0.1) AS low, quantile_cont(residual, 0.9) AS high, count(*) AS n FROM o_resid
UNION ALL SELECT * FROM (SELECT 'cold', NULL, quantile_cont(residual, 0.1), quantile_cont(residual, 0.9), count(*) AS n FROM o_resid WHERE cold) WHERE n >= 50
UNION ALL SELECT * FROM (SELECT 'class', vessel_class, quantile_cont(residual, 0.1), quantile_cont(residual, 0.9), count(*) AS n FROM o_resid WHERE NOT cold GROUP BY vessel_class) WHERE n >= 50""")


def class_mean_scored(t: Inputs):
    # levels, residuals and bands all read the features: build them once
    rows = cut_lineage(featured(t))
    levels = stats.class_levels(rows)
    return model.class_mean_intensity(rows, levels), levels


def class_mean_bands(scored: DataFrame) -> DataFrame:
    residuals = scored.select(
        "vessel_class", (F.ln("target") - F.ln("intensity")).alias("residual"), model.cold_start().alias("cold_start"))
    return stats.residual_bands(residuals)


@query("agg_residual_bands", "SELECT scope, vessel_class, round(low, 9) + 0e0 AS low, round(high, 9) + 0e0 AS high, n FROM o_band")
def _(t: Inputs):
    scored, _ = class_mean_scored(t)
    return class_mean_bands(scored).select("scope", "vessel_class", rnd("low", 9).alias("low"), rnd("high", 9).alias("high"), "n")


cte("o_moment", """
SELECT ship_type, grouping(ship_type) AS is_all, count(*) AS n_rows, count(p) AS valid, avg(d) AS md, avg(v) AS mv, avg(p) AS mp,
  var_pop(d) AS dd, var_pop(v) AS vv, covar_pop(d, v) AS dv, covar_pop(d, p) AS dp, covar_pop(v, p) AS vp FROM (
  SELECT ship_type, CASE WHEN ok THEN ln(cargo_carried_t) END AS d, CASE WHEN ok THEN ln(mean_speed_kn) END AS v, CASE WHEN ok THEN ln(mean_power_kw) END AS p FROM (
    SELECT *, COALESCE(cargo_carried_t > 0 AND mean_speed_kn > 0 AND mean_power_kw > 0, FALSE) AS ok FROM o_usable)) GROUP BY GROUPING SETS ((ship_type), ())""")
cte("o_fit", """
SELECT *, mp - b * md - n * mv AS a FROM (SELECT *, greatest(0e0, least(1.5e0, (dp * vv - vp * dv) / (dd * vv - dv * dv))) AS b,
   greatest(0.5e0, least(4.5e0, (vp * dd - dp * dv) / (dd * vv - dv * dv))) AS n FROM o_moment)""")


@query("agg_physics_ols", """
SELECT COALESCE(ship_type, '__pooled__') AS ship_type, round(a, 5) + 0e0 AS intercept, round(b, 6) + 0e0 AS displacement_exponent, round(n, 6) + 0e0 AS speed_exponent, valid AS n_train FROM o_fit""")
def _(t: Inputs):
    out = physics.fit(t.usable)
    return out.select("ship_type", rnd("intercept", 5).alias("intercept"), rnd("displacement_exponent", 6).alias("displacement_exponent"),
                      rnd("speed_exponent", 6).alias("speed_exponent"), "n_train")


@query("agg_physics_theoretical", """
SELECT COALESCE(ship_type, '__pooled__') AS ship_type, round(mp - 2e0 / 3e0 * md - 3e0 * mv, 6) + 0e0 AS intercept, valid AS n_train FROM o_moment""")
def _(t: Inputs):
    return physics.fit(t.usable, "theoretical").select("ship_type", rnd("intercept", 6).alias("intercept"), "n_train")


POOL_AT = 1_000_000_000


@query("agg_physics_pooled", f"""
SELECT f.ship_type, round(p.a, 5) + 0e0 AS intercept, round(p.b, 6) + 0e0 AS displacement_exponent, round(p.n, 6) + 0e0 AS speed_exponent,
  f.n_rows AS n_train, f.n_rows < {POOL_AT} AS pooled FROM o_fit f CROSS JOIN o_fit p WHERE p.is_all = 1 AND f.is_all = 0""")
def _(t: Inputs):
    # a threshold above every group size: all types must take the pooled coefficients
    out = physics.fit(t.usable, min_group_size=POOL_AT).where(F.col("ship_type") != physics.POOLED)
    return out.select("ship_type", rnd("intercept", 5).alias("intercept"), rnd("displacement_exponent", 6).alias("displacement_exponent"),
                      rnd("speed_exponent", 6).alias("speed_exponent"), "n_train", "pooled")


@query("agg_coefficient_table", """
SELECT ship_type, round(a, 6) + 0e0 AS intercept, round(b, 4) + 0e0 AS displacement_exponent, round(n, 4) + 0e0 AS speed_exponent, valid AS n_train, FALSE AS pooled FROM o_fit WHERE is_all = 0""")
def _(t: Inputs):
    return physics.coefficient_table(physics.fit(t.usable))


@query("agg_icc", """
SELECT count(*) AS ships, round(avg(sd), 8) + 0e0 AS within_sd, round(stddev_samp(m), 8) + 0e0 AS between_sd,
  round(stddev_samp(m) * stddev_samp(m) / (stddev_samp(m) * stddev_samp(m) + avg(sd) * avg(sd)), 8) + 0e0 AS icc FROM (
  SELECT imo, stddev_samp(ln(target)) AS sd, avg(ln(target)) AS m FROM o_feat WHERE target > 0 GROUP BY imo HAVING count(*) >= 5)""")
def _(t: Inputs):
    return stats.icc(t.usable).select("ships", *[rnd(c, 8).alias(c) for c in ("within_sd", "between_sd", "icc")])


@query("agg_gwp_recovery", """
SELECT count(*) AS n, 28e0 AS gwp_ch4, 265e0 AS gwp_n2o, max(abs(total_co2eq_t - total_co2_t - 28 * total_ch4_t - 265 * total_n2o_t)) = 0 AS exact
FROM o_panel WHERE total_co2eq_t IS NOT NULL AND total_co2_t IS NOT NULL AND total_ch4_t IS NOT NULL AND total_n2o_t IS NOT NULL""")
def _(t: Inputs):
    out = stats.gwp_recovery(t.panel)
    return out.select("n", rnd("gwp_ch4", 6).alias("gwp_ch4"), rnd("gwp_n2o", 6).alias("gwp_n2o"), (F.col("max_relative_residual") < 1e-9).alias("exact"))


@query("agg_measured_factors", """
SELECT fuel_class, count(*) AS ship_years, round(quantile_cont(ch4, 0.5), 8) + 0e0 AS ch4_g_per_kg, round(quantile_cont(n2o, 0.5), 8) + 0e0 AS n2o_g_per_kg,
  round(quantile_cont(ch4, 0.25) / 10e0, 8) + 0e0 AS slip_pct_p25, round(quantile_cont(ch4, 0.5) / 10e0, 8) + 0e0 AS slip_pct_p50,
  round(quantile_cont(ch4, 0.75) / 10e0, 8) + 0e0 AS slip_pct_p75, round(quantile_cont(ch4, 0.95) / 10e0, 8) + 0e0 AS slip_pct_p95 FROM (
  SELECT CASE WHEN cf < (2.75e0 + 3.114e0) / 2 THEN 'lng' WHEN cf < (3.114e0 + 3.206e0) / 2 THEN 'hfo' ELSE 'mgo' END AS fuel_class,
         total_ch4_t / total_fuel_t * 1000e0 AS ch4, total_n2o_t / total_fuel_t * 1000e0 AS n2o FROM o_energy WHERE total_fuel_t > 0 AND total_ch4_t IS NOT NULL) GROUP BY fuel_class""")
def _(t: Inputs):
    out = stats.measured_factors(t.stored)
    return out.select("fuel_class", "ship_years", *[rnd(c, 8).alias(c) for c in (
        "ch4_g_per_kg", "n2o_g_per_kg", "slip_pct_p25", "slip_pct_p50", "slip_pct_p75", "slip_pct_p95")])


@query("agg_run_summary", """
SELECT seed, count(*) AS n_runs, round(avg(predicted), 8) + 0e0 AS mean, round(COALESCE(stddev_samp(predicted), 0e0), 8) + 0e0 AS std, min(predicted) AS best, max(predicted) AS worst,
  round(quantile_cont(predicted, 0.5), 8) + 0e0 AS median FROM (SELECT seed, round(predicted, 9) + 0e0 AS predicted FROM v_prediction) GROUP BY seed""")
def _(t: Inputs):
    runs = t.view("v_prediction").select("seed", rnd("predicted", 9).alias("predicted"))
    out = stats.run_summary(runs, "predicted", ["seed"])
    return out.select("seed", "n_runs", rnd("mean", 8).alias("mean"), rnd("std", 8).alias("std"), "best", "worst", rnd("median", 8).alias("median"))


@query("agg_wilcoxon", """
SELECT CAST(sum(cnt) AS BIGINT) AS n, round(sum(rk * plus), 1) + 0e0 AS w_plus, round(sum(rk * minus), 1) + 0e0 AS w_minus,
  round((least(sum(rk * plus), sum(rk * minus)) - sum(cnt) * (sum(cnt) + 1e0) / 4e0) / sqrt(sum(cnt) * (sum(cnt) + 1e0) * (2e0 * sum(cnt) + 1e0) / 24e0 - sum(CAST(cnt AS DOUBLE) * cnt * cnt - cnt) / 48e0), 7) + 0e0 AS z
FROM (SELECT sz, cnt, plus, minus, sum(cnt) OVER (ORDER BY sz) - cnt + (cnt + 1) / 2e0 AS rk FROM (
  SELECT abs(d) AS sz, count(*) AS cnt, count(*) FILTER (d > 0) AS plus, count(*) FILTER (d < 0) AS minus FROM (
    SELECT round((abs(predicted - actual) - abs(alternative - actual)) * 1e4) AS d FROM v_prediction WHERE predicted IS NOT NULL AND alternative IS NOT NULL) WHERE d <> 0 GROUP BY 1))""")
def _(t: Inputs):
    gap = F.round((F.abs(F.col("predicted") - F.col("actual")) - F.abs(F.col("alternative") - F.col("actual"))) * 1e4, 0)
    pairs = t.view("v_prediction").select(gap.alias("gap"), F.lit(0.0).alias("zero"))
    out = stats.wilcoxon(pairs, "gap", "zero")
    return out.select("n", rnd("w_plus", 1).alias("w_plus"), rnd("w_minus", 1).alias("w_minus"), rnd("z", 7).alias("z"))


@query("agg_panel_coverage", """
SELECT CAST(sum(n) AS BIGINT) AS ship_years, count(*) AS ships, count(*) FILTER (n > 1) AS recurring_ships, min(lo) AS first_period, max(hi) AS last_period
FROM (SELECT imo, count(*) AS n, min(reporting_period) AS lo, max(reporting_period) AS hi FROM o_panel GROUP BY imo)""")
def _(t: Inputs):
    return stats.panel_coverage(t.panel)


# --------------------------------------------------------------------------- model scoring
@query("mdl_class_mean", "SELECT f.imo, f.period, round(exp(l.log_level), 7) + 0e0 AS intensity FROM o_feat f JOIN o_level l ON l.vessel_class = f.vessel_class AND l.is_global = 0")
def _(t: Inputs):
    scored, _ = class_mean_scored(t)
    return scored.select("imo", "period", rnd("intensity", 7).alias("intensity"))


@query("mdl_cold_start", """
SELECT f.imo, f.period, f.design IS NULL OR c.vessel_class IS NULL AS cold_start FROM o_feat f JOIN o_vsplit s ON s.imo = f.imo
LEFT JOIN (SELECT DISTINCT f.vessel_class FROM o_feat f JOIN o_vsplit s ON s.imo = f.imo WHERE s.split = 'train' AND f.vessel_class <> 'ropax') c ON c.vessel_class = f.vessel_class WHERE s.split = 'test'""")
def _(t: Inputs):
    # ro-pax ships are left out of training so that an unseen class occurs
    rows = cut_lineage(splits.split_by_vessel(featured(t)))
    levels = stats.class_levels(rows.where((F.col("split") == "train") & (F.col("vessel_class") != "ropax")))
    test = model.class_mean_intensity(rows.where("split = 'test'"), levels)
    return test.select("imo", "period", model.cold_start().alias("cold_start"))


cte("o_scored", """
SELECT f.*, exp(l.log_level) AS intensity, c.reference_speed_kn AS vr, c.aux_share AS aux, COALESCE(b.low, g.low) AS bl, COALESCE(b.high, g.high) AS bh, k.low AS kl, k.high AS kh
FROM o_feat f JOIN o_level l ON l.vessel_class = f.vessel_class AND l.is_global = 0 JOIN o_class c ON c.vessel_class = f.vessel_class
LEFT JOIN o_band b ON b.scope = 'class' AND b.vessel_class = f.vessel_class JOIN o_band g ON g.scope = 'global' LEFT JOIN o_band k ON k.scope = 'cold'""")
POWER = "intensity * vr / 3.6e0 * ((1e0 - aux) * pow(1e0, 2e0 / 3e0) * pow({v} / vr, 3e0) + aux)"


@query("mdl_physics_power", f"SELECT imo, period, round({POWER.format(v='mean_speed_kn')}, 6) + 0e0 AS power_kw FROM o_scored")
def _(t: Inputs):
    scored, _ = class_mean_scored(t)
    rows = model.reference_points(scored)
    power = model.power_kw(F.col("intensity"), F.col("reference_speed_kn"), F.col("aux_share"), F.col("mean_speed_kn"), F.lit(1.0))
    return rows.select("imo", "period", rnd(power, 6).alias("power_kw"))


@query("mdl_energy_per_nmi", f"""
SELECT imo, period, round({POWER.format(v='mean_speed_kn')} * 3.6e0 / mean_speed_kn, 6) + 0e0 AS at_speed, CAST(NULL AS DOUBLE) AS at_rest FROM o_scored""")
def _(t: Inputs):
    scored, _ = class_mean_scored(t)
    rows = model.reference_points(scored)

    def at(speed):
        return model.energy_per_nmi(model.power_kw(F.col("intensity"), F.col("reference_speed_kn"), F.col("aux_share"), speed, F.lit(1.0)), speed)

    return rows.select("imo", "period", rnd(at(F.col("mean_speed_kn")), 6).alias("at_speed"), rnd(at(F.lit(0.0)), 6).alias("at_rest"))


@query("mdl_predict_interval", f"""
SELECT imo, period, round(e, 3) + 0e0 AS p50, round(e * exp(CASE WHEN cold THEN least(bl * 1.8e0, COALESCE(kl, bl * 1.8e0)) ELSE bl END * w), 3) + 0e0 AS p10,
  round(e * exp(CASE WHEN cold THEN greatest(bh * 1.8e0, COALESCE(kh, bh * 1.8e0)) ELSE bh END * w), 3) + 0e0 AS p90, cold AS cold_start, mean_speed_kn / vr < 0.6e0 OR mean_speed_kn / vr > 1.4e0 AS extrapolating
FROM (SELECT *, design IS NULL AS cold, {POWER.format(v='mean_speed_kn')} * 3.6e0 / mean_speed_kn AS e, 1e0 + 1.5e0 * abs(ln(greatest(mean_speed_kn / vr, 0.01e0 / vr))) AS w FROM o_scored)""")
def _(t: Inputs):
    scored, _ = class_mean_scored(t)
    out = model.predict(scored, class_mean_bands(scored), "mean_speed_kn")
    return out.select("imo", "period", rnd("predicted_energy_per_nmi_mj", 3).alias("p50"), rnd("p10", 3).alias("p10"), rnd("p90", 3).alias("p90"), "cold_start", "extrapolating")


@query("mdl_reference_point", "SELECT f.imo, f.period, c.reference_speed_kn, c.aux_share FROM o_feat f JOIN o_class c ON c.vessel_class = f.vessel_class")
def _(t: Inputs):
    return model.reference_points(featured(t)).select("imo", "period", "reference_speed_kn", "aux_share")


cte("o_vfeat", """
SELECT v.*, COALESCE(exp(l.log_level), exp(g.log_level)) AS intensity, c.reference_speed_kn AS vr, c.aux_share AS aux, l.vessel_class IS NULL OR v.design_efficiency_gco2_per_t_nmi IS NULL AS cold,
  COALESCE(b.low, gb.low) AS bl, COALESCE(b.high, gb.high) AS bh, k.low AS kl, k.high AS kh
FROM v_vessel v LEFT JOIN o_level l ON l.vessel_class = v.vessel_class AND l.is_global = 0 JOIN o_level g ON g.is_global = 1 JOIN o_class c ON c.vessel_class = v.vessel_class
LEFT JOIN o_band b ON b.scope = 'class' AND b.vessel_class = v.vessel_class JOIN o_band gb ON gb.scope = 'global' LEFT JOIN o_band k ON k.scope = 'cold'""")


def scored_vessels(t: Inputs):
    scored, levels = class_mean_scored(t)
    vessels = fleet.vessel_features(t.view("v_vessel"), 2030, keep=["vessel", "capacity_t"])
    return model.class_mean_intensity(vessels, levels), class_mean_bands(scored)


@query("mdl_speed_curves", """
SELECT vessel, vessel_class, round(intensity, 7) + 0e0 AS reference_intensity_mj_per_nmi, vr AS reference_speed_kn, aux AS aux_share, cold AS cold_start FROM o_vfeat""")
def _(t: Inputs):
    scored, _ = scored_vessels(t)
    out = model.speed_curves(scored)
    return out.select("vessel", "vessel_class", rnd("reference_intensity_mj_per_nmi", 7).alias("reference_intensity_mj_per_nmi"), "reference_speed_kn", "aux_share", "cold_start")


MASSES = ", ".join(
    f"round(e * 1000e0 / {eff}e0 / {lhv}e0 / 1000e0, 7) + 0e0 AS {f}_t" for f, eff, lhv in (
        ("hfo", 0.45, 40.2), ("mgo", 0.45, 42.7), ("lng", 0.45, 48.0), ("methanol", 0.45, 19.9), ("ammonia", 0.45, 18.6), ("hydrogen", 0.5, 120.0)))


@query("mdl_speed_sweep", f"""
SELECT vessel, point, round(v, 9) + 0e0 AS speed_kn, round(e, 3) + 0e0 AS energy_per_nmi_mj, round(e * exp(CASE WHEN cold THEN least(bl * 1.8e0, COALESCE(kl, bl * 1.8e0)) ELSE bl END * w), 3) + 0e0 AS p10,
  round(e * exp(CASE WHEN cold THEN greatest(bh * 1.8e0, COALESCE(kh, bh * 1.8e0)) ELSE bh END * w), 3) + 0e0 AS p90, round(p, 3) + 0e0 AS power_kw, v / vr < 0.6e0 OR v / vr > 1.4e0 AS extrapolating, {MASSES}
FROM (SELECT *, CASE WHEN v > 0.01e0 THEN p * 3.6e0 / v END AS e, 1e0 + 1.5e0 * abs(ln(greatest(v / vr, 0.01e0 / vr))) AS w FROM (
  SELECT *, {POWER.format(v='v')} AS p FROM (SELECT f.*, CAST(i AS INTEGER) AS point, i * (vr * 1.25e0 / 25) AS v FROM o_vfeat f CROSS JOIN (SELECT unnest(range(0, 26)) AS i))))""")
def _(t: Inputs):
    scored, bands = scored_vessels(t)
    out = model.speed_sweep(scored, bands, ["vessel"])
    return out.select(
        "vessel", "point", rnd("speed_kn", 9).alias("speed_kn"), rnd("predicted_energy_per_nmi_mj", 3).alias("energy_per_nmi_mj"),
        rnd("p10", 3).alias("p10"), rnd("p90", 3).alias("p90"), rnd("power_kw", 3).alias("power_kw"), "extrapolating",
        *[rnd(F.col("fuel_t_per_1000_nmi")[f], 7).alias(f"{f}_t") for f in model.COMBUSTIBLE])


@query("mdl_optimal_speed", "SELECT imo, period, round(vr * cbrt(aux / (2e0 * (1e0 - aux) * pow(0.8e0, 2e0 / 3e0))), 9) + 0e0 AS optimal_speed_kn FROM o_scored")
def _(t: Inputs):
    rows = model.reference_points(featured(t))
    return rows.select("imo", "period", rnd(model.optimal_speed(F.col("reference_speed_kn"), F.col("aux_share"), F.lit(0.8)), 9).alias("optimal_speed_kn"))


@query("mdl_physics_predict", """
SELECT u.imo, u.reporting_period, round(exp(COALESCE(f.a, p.a) + COALESCE(f.b, p.b) * ln(u.cargo_carried_t) + COALESCE(f.n, p.n) * ln(u.mean_speed_kn)), 3) + 0e0 AS predicted_power_kw, f.ship_type IS NULL AS cold_start
FROM o_usable u LEFT JOIN (SELECT * FROM o_fit WHERE is_all = 0 AND ship_type <> 'Ro-pax ship') f ON f.ship_type = u.ship_type CROSS JOIN (SELECT * FROM o_fit WHERE is_all = 1) p""")
def _(t: Inputs):
    # one type is dropped from the coefficients so that the pooled fallback shows
    coefficients = physics.fit(t.usable).where(F.col("ship_type") != "Ro-pax ship")
    out = physics.predict(t.usable, coefficients)
    return out.select(*KEY, rnd("predicted_power_kw", 3).alias("predicted_power_kw"), "cold_start")


@query("mdl_check_monotone_speed", "SELECT vessel_class, count(*) AS n, CAST(0 AS BIGINT) AS falls FROM o_feat GROUP BY vessel_class")
def _(t: Inputs):
    scored, _ = class_mean_scored(t)
    return model.check_monotone_speed(scored).groupBy("vessel_class").agg(F.count(F.lit(1)).alias("n"), F.sum("falls").alias("falls"))


@query("mdl_check_zero_speed", "SELECT imo, period, round(intensity * vr / 3.6e0 * aux, 6) + 0e0 AS rest_power_kw, TRUE AS rest_ok FROM o_scored")
def _(t: Inputs):
    scored, _ = class_mean_scored(t)
    return model.check_zero_speed(scored).select("imo", "period", rnd("rest_power_kw", 6).alias("rest_power_kw"), "rest_ok")
