"""Aggregations and statistics over the panel and over predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bunkerline import reference as ref
from bunkerline.functions.ordering import exact_percentiles, value_positions
from bunkerline.operators import emissions
from bunkerline.operators.features import resolve_class

OVERALL = "__overall__"


def usable_pairs(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Rows with both values and a positive actual; NaN and infinities do not count."""
    finite = [
        F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf")) for c in (actual, predicted)
    ]
    return df.where(finite[0] & finite[1] & (F.col(actual) > 0))


def metric_columns(actual: str, predicted: str) -> list[Column]:
    error = F.col(predicted) - F.col(actual)
    spread = F.var_pop(actual) * F.count(actual)
    return [
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        (F.avg(F.abs(error) / F.col(actual)) * 100.0).alias("mape"),
        F.when(spread > 0, 1.0 - F.sum(error * error) / spread).alias("r2"),
        F.avg(error).alias("bias"),
    ]


def regression_metrics(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """One row: n, MAE, RMSE, MAPE %, R2 (null without variance), bias, median APE %."""
    table = metrics_by_group(df.withColumn("_g", F.lit("all")), "_g", actual, predicted)
    return table.where(F.col("group") == OVERALL).drop("group", "reliable")


def metrics_by_group(
    df: DataFrame, group: str, actual: str = "actual", predicted: str = "predicted", min_count: int = 30
) -> DataFrame:
    """Per group plus an overall row, listed last. A null group is a group; small ones are marked."""
    rows = usable_pairs(df, actual, predicted).withColumn(
        "_ape", F.abs(F.col(predicted) - F.col(actual)) / F.col(actual) * 100.0
    )
    grouped = rows.rollup(group).agg(F.grouping(group).alias("_all"), *metric_columns(actual, predicted))
    both = rows.select(
        "_ape",
        F.explode(F.array(
            F.struct(F.lit(0).alias("_all"), F.col(group).alias(group)),
            F.struct(F.lit(1).alias("_all"), F.lit(None).cast(df.schema[group].dataType).alias(group)),
        )).alias("g"),
    ).select("_ape", "g.*")
    medians = exact_percentiles(both, ["_all", group], "_ape", {"median_ape": 0.5}).drop("n")
    on = (grouped["_all"] == medians["_all"]) & grouped[group].eqNullSafe(medians[group])
    joined = grouped.join(medians, on).select(grouped["*"], medians["median_ape"])
    overall = F.col("_all") == 1
    return joined.select(
        F.when(overall, OVERALL).otherwise(F.col(group).cast("string")).alias("group"),
        "n", "mae", "rmse", "mape", "r2", "bias", "median_ape",
        (overall | (F.col("n") >= min_count)).alias("reliable"),
        F.col("_all").alias("_all"),
    ).orderBy("_all", "group").drop("_all")


def interval_metrics(
    df: DataFrame, actual: str = "actual", low: str = "p10", high: str = "p90", nominal: float = 0.8
) -> DataFrame:
    """Empirical coverage and width of a prediction interval."""
    a, lo, hi = F.col(actual), F.col(low), F.col(high)
    rows = df.where((a > 0) & lo.isNotNull() & hi.isNotNull())

    def share(condition: Column) -> Column:
        return F.avg(condition.cast("double"))

    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.lit(nominal).alias("nominal_coverage"),
        share((a >= lo) & (a <= hi)).alias("empirical_coverage"),
        (share((a >= lo) & (a <= hi)) - nominal).alias("coverage_error"),
        F.avg((hi - lo) / a).alias("mean_relative_width"),
        share(a < lo).alias("below_p10"), share(a > hi).alias("above_p90"),
    )


def class_levels(training: DataFrame, target: str = "target") -> DataFrame:
    """Mean log target per class and, with a null class, over everything."""
    rows = training.where(F.col(target) > 0)
    return rows.rollup("vessel_class").agg(
        F.grouping("vessel_class").alias("is_global"), F.avg(F.ln(target)).alias("log_level"),
        F.count(F.lit(1)).alias("n"),
    )


def residual_bands(residuals: DataFrame, residual: str = "residual", cold: str = "cold_start") -> DataFrame:
    """(scope, vessel_class, low, high, n): global, cold and per-class (warm rows) 10/90 % bands.

    Too few rows: the global band falls back to the default, the others are left out.
    """
    finite = residuals.where(F.col(residual).isNotNull() & ~F.isnan(residual))
    scopes = F.array_compact(F.array(
        F.struct(F.lit("global").alias("scope"), F.lit(None).cast("string").alias("vessel_class")),
        F.when(F.col(cold), F.struct(F.lit("cold").alias("scope"), F.lit(None).cast("string").alias("vessel_class"))),
        F.when(~F.col(cold), F.struct(F.lit("class").alias("scope"), F.col("vessel_class").alias("vessel_class"))),
    ))
    long = finite.select(F.col(residual).alias("_r"), F.explode(scopes).alias("s")).select("_r", "s.*")
    bands = exact_percentiles(long, ["scope", "vessel_class"], "_r", {"low": 0.1, "high": 0.9})
    scarce = (F.col("scope") == "global") & (F.col("n") < ref.GLOBAL_BAND_MIN_ROWS)
    return bands.where(
        (F.col("scope") == "global") | (F.col("n") >= ref.BAND_MIN_ROWS)
    ).select(
        "scope", "vessel_class",
        F.when(scarce, ref.DEFAULT_BAND[0]).otherwise(F.col("low")).alias("low"),
        F.when(scarce, ref.DEFAULT_BAND[1]).otherwise(F.col("high")).alias("high"), "n",
    )


def cf_crosscheck(derived: DataFrame) -> DataFrame:
    """Percentiles of published CO2 per distance over fuel per distance x Cf, minus one."""
    expected = F.col("fuel_per_distance_kg_per_nmi") * F.col("implied_cf_t_per_t")
    rows = derived.where(expected > 0).select(
        (F.col("co2_per_distance_kg_per_nmi") / expected - 1.0).alias("residual")
    )
    return exact_percentiles(rows, [], "residual", {"p05": 0.05, "p50": 0.5, "p95": 0.95})


def icc(usable: DataFrame, min_years: int = 5) -> DataFrame:
    """Share of log-intensity variance that belongs to the ship."""
    intensity = F.col("inferred_lhv_mj_per_kg") * F.col("fuel_per_distance_kg_per_nmi")
    per_ship = (
        usable.where(intensity > 0).withColumn("_l", F.ln(intensity)).groupBy("imo")
        .agg(F.count("_l").alias("n"), F.stddev_samp("_l").alias("sd"), F.avg("_l").alias("mean"))
        .where(F.col("n") >= min_years)
    )
    parts = per_ship.agg(
        F.count(F.lit(1)).alias("ships"), F.avg("sd").alias("within_sd"), F.stddev_samp("mean").alias("between_sd")
    )
    w2, b2 = F.col("within_sd") * F.col("within_sd"), F.col("between_sd") * F.col("between_sd")
    return parts.withColumn("icc", F.when(b2 + w2 > 0, b2 / (b2 + w2)))


def gwp_recovery(filings: DataFrame) -> DataFrame:
    """CH4 and N2O potentials implied by filed CO2eq - CO2 (least squares, no intercept)."""
    rows = filings.where(
        F.col("total_co2eq_t").isNotNull() & F.col("total_co2_t").isNotNull()
        & F.col("total_ch4_t").isNotNull() & F.col("total_n2o_t").isNotNull()
    ).select(
        (F.col("total_co2eq_t") - F.col("total_co2_t")).alias("y"),
        F.col("total_ch4_t").alias("c"), F.col("total_n2o_t").alias("o"),
    )
    sums = rows.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(F.col(a) * F.col(b)).alias(a + b) for a, b in ("cc", "co", "oo", "cy", "oy")],
    )
    det = F.col("cc") * F.col("oo") - F.col("co") * F.col("co")
    fitted = sums.select(
        "n",
        F.when(det != 0, (F.col("cy") * F.col("oo") - F.col("oy") * F.col("co")) / det).alias("gwp_ch4"),
        F.when(det != 0, (F.col("oy") * F.col("cc") - F.col("cy") * F.col("co")) / det).alias("gwp_n2o"),
    )
    # second pass for the worst residual: the fit is one row, joined on a constant key
    keyed = rows.withColumn("_k", F.lit(1)).join(F.broadcast(fitted.withColumn("_k", F.lit(1))), "_k")
    error = F.abs(F.col("y") - F.col("gwp_ch4") * F.col("c") - F.col("gwp_n2o") * F.col("o"))
    return keyed.agg(
        F.max("n").alias("n"), F.max("gwp_ch4").alias("gwp_ch4"), F.max("gwp_n2o").alias("gwp_n2o"),
        F.max(F.when(F.col("y") != 0, error / F.abs(F.col("y")))).alias("max_relative_residual"),
    )


def fuel_class(cf: Column) -> Column:
    """Nearest pure fuel on the blend ladder."""
    (a, c0, _), (b, c1, _), (c, c2, _) = ref.BLEND_LADDER
    return F.when(cf < (c0 + c1) / 2, a).when(cf < (c1 + c2) / 2, b).when(cf.isNotNull(), c)


def measured_factors(derived: DataFrame) -> DataFrame:
    """Measured CH4 and N2O, g per kg of fuel, and slip % percentiles, by nearest fuel."""
    rows = derived.where((F.col("total_fuel_t") > 0) & F.col("total_ch4_t").isNotNull()).select(
        fuel_class(F.col("implied_cf_t_per_t")).alias("fuel_class"),
        (F.col("total_ch4_t") / F.col("total_fuel_t") * 1000.0).alias("ch4"),
        (F.col("total_n2o_t") / F.col("total_fuel_t") * 1000.0).alias("n2o"),
    )
    points = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}
    ch4 = exact_percentiles(rows, ["fuel_class"], "ch4", points).withColumnRenamed("n", "ship_years")
    n2o = exact_percentiles(rows, ["fuel_class"], "n2o", {"n2o_p50": 0.5}).drop("n")
    return ch4.join(n2o, "fuel_class").select(
        "fuel_class", "ship_years", F.col("p50").alias("ch4_g_per_kg"), F.col("n2o_p50").alias("n2o_g_per_kg"),
        *[(F.col(p) / 10.0).alias(f"slip_pct_{p}") for p in points],
    )


def run_summary(runs: DataFrame, score: str, groups: Sequence[str] = ()) -> DataFrame:
    """Across repeated runs: n, mean, sd (0 for one run), best, worst, median of finite scores."""
    finite = F.col(score).isNotNull() & ~F.isnan(score) & (F.abs(F.col(score)) != float("inf"))
    value = F.when(finite, F.col(score))
    stats = runs.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n_runs"), F.avg(value).alias("mean"),
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"),
        F.min(value).alias("best"), F.max(value).alias("worst"),
    )
    middle = exact_percentiles(runs.where(finite), groups, score, {"median": 0.5}).drop("n")
    if not groups:
        return stats.withColumn("_k", F.lit(1)).join(middle.withColumn("_k", F.lit(1)), "_k").drop("_k")
    return stats.join(middle, list(groups))


# fixed values: Abramowitz-Stegun 7.1.26 coefficients for the error function
ERF = (0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429))


def erf_abs(x: Column) -> Column:
    p, coefficients = ERF
    t = 1.0 / (1.0 + p * F.abs(x))
    poly = F.lit(0.0)
    for c in reversed(coefficients):
        poly = (poly + c) * t
    return 1.0 - poly * F.exp(-x * x)


def wilcoxon(pairs: DataFrame, first: str, second: str) -> DataFrame:
    """Paired signed-rank test with tie correction and the normal approximation.

    Average ranks come from per-value positions, so ties collapse before the shuffle and no
    task ranks the whole sample.
    """
    d = pairs.where(F.col(first).isNotNull() & F.col(second).isNotNull()).select(
        (F.col(first) - F.col(second)).alias("d")
    ).where(F.col("d") != 0)
    signed = d.groupBy(F.abs("d").alias("size")).agg(
        F.count_if(F.col("d") > 0).alias("plus"), F.count_if(F.col("d") < 0).alias("minus")
    )
    placed = value_positions(d.select(F.abs("d").alias("size")), [], "size")
    ranked = placed.join(signed, "size").withColumn("rank", F.col("below") + (F.col("cnt") + 1) / 2.0)
    ties = F.col("cnt") * F.col("cnt") * F.col("cnt") - F.col("cnt")
    sums = ranked.agg(
        F.sum("cnt").alias("n"), F.sum(F.col("rank") * F.col("plus")).alias("w_plus"),
        F.sum(F.col("rank") * F.col("minus")).alias("w_minus"), F.sum(ties.cast("double")).alias("_ties"),
    )
    n = F.col("n").cast("double")
    mean = n * (n + 1.0) / 4.0
    sd = F.sqrt(n * (n + 1.0) * (2.0 * n + 1.0) / 24.0 - F.col("_ties") / 48.0)
    z = (F.least("w_plus", "w_minus") - mean) / sd
    return sums.select(
        "n", "w_plus", "w_minus", z.alias("z"), (1.0 - erf_abs(z / F.sqrt(F.lit(2.0)))).alias("p_value")
    )


def panel_coverage(panel: DataFrame) -> DataFrame:
    """Ship-years, ships, periods and ships filed in more than one period."""
    per_ship = panel.groupBy("imo").agg(
        F.count(F.lit(1)).alias("n"), F.min("reporting_period").alias("lo"), F.max("reporting_period").alias("hi")
    )
    return per_ship.agg(
        F.sum("n").alias("ship_years"), F.count("imo").alias("ships"),
        F.count_if(F.col("n") > 1).alias("recurring_ships"),
        F.min("lo").alias("first_period"), F.max("hi").alias("last_period"),
    )


def class_period_summary(usable: DataFrame) -> DataFrame:
    """Ship-years, median speed, energy per mile and diesel lifecycle emissions by class and year."""
    rows = resolve_class(usable)
    groups = ["vessel_class", "reporting_period"]
    per_mj = emissions.total_per_mj("mgo", "fossil")
    work = F.col("energy_mj") * emissions.fuel_value("mgo", "efficiency")
    sums = rows.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("ship_years"), F.avg("energy_per_nmi_mj").alias("mean_energy_per_nmi_mj"),
        (F.sum(work) * per_mj / 1000.0).alias("mgo_ktco2e"),
    )
    speed = exact_percentiles(rows, groups, "mean_speed_kn", {"median_speed_kn": 0.5}).drop("n")
    return sums.join(speed, groups)
