"""Admiralty-style power baseline: log P = a + b log D + n log V per ship type.

Least squares is solved in closed form from centred second moments, so a fit is one
aggregation whatever the number of rows; hot types are combined map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bunkerline import reference as ref
from bunkerline.functions.expr import clip

THEORETICAL = (2.0 / 3.0, 3.0)
POOLED = "__pooled__"


def _positive_log(column: str) -> Column:
    return F.when(F.col(column) > 0, F.ln(column))


def fit(
    training: DataFrame, mode: str = "calibrated", group: str = "ship_type", size: str = "cargo_carried_t",
    speed: str = "mean_speed_kn", power: str = "mean_power_kw", min_group_size: int = 30,
) -> DataFrame:
    """Coefficients per type plus one ``__pooled__`` row; small types take the pooled ones."""
    if mode not in ("calibrated", "theoretical"):
        raise ValueError(f"mode must be calibrated or theoretical, not {mode!r}")
    logs = training.select(
        F.col(group).alias("ship_type"), _positive_log(size).alias("d"), _positive_log(speed).alias("v"),
        _positive_log(power).alias("p"),
    )
    whole = F.col("d").isNotNull() & F.col("v").isNotNull() & F.col("p").isNotNull()
    d, v, p = (F.when(whole, F.col(c)) for c in ("d", "v", "p"))
    moments = logs.rollup("ship_type").agg(
        F.grouping("ship_type").alias("_all"), F.count(F.lit(1)).alias("rows"), F.count(d).alias("valid"),
        F.avg(d).alias("md"), F.avg(v).alias("mv"), F.avg(p).alias("mp"),
        F.var_pop(d).alias("dd"), F.var_pop(v).alias("vv"), F.covar_pop(d, v).alias("dv"),
        F.covar_pop(d, p).alias("dp"), F.covar_pop(v, p).alias("vp"),
    )
    if mode == "theoretical":
        b, n = F.lit(THEORETICAL[0]), F.lit(THEORETICAL[1])
        usable = F.col("valid") >= 3
    else:
        det = F.col("dd") * F.col("vv") - F.col("dv") * F.col("dv")
        usable = (F.col("valid") >= 3) & (det > 1e-12 * F.col("dd") * F.col("vv"))
        raw_b = F.when(usable, (F.col("dp") * F.col("vv") - F.col("vp") * F.col("dv")) / det)
        raw_n = F.when(usable, (F.col("vp") * F.col("dd") - F.col("dp") * F.col("dv")) / det)
        b = clip(raw_b, *ref.SIZE_EXPONENT_BOUNDS)
        n = clip(raw_n, *ref.SPEED_EXPONENT_BOUNDS)
    # the intercept puts the (possibly clipped) plane through the centre of mass
    solved = moments.select("*", usable.alias("usable"), b.alias("b"), n.alias("n"), F.lit(1).alias("_k")).withColumn(
        "a", F.col("mp") - F.col("b") * F.col("md") - F.col("n") * F.col("mv"))
    pooled = solved.where(F.col("_all") == 1).select(
        "_k", F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("n").alias("pn"), F.col("valid").alias("pvalid")
    )
    small = (F.col("rows") < min_group_size) | ~F.col("usable")
    by_type = solved.where((F.col("_all") == 1) | F.col("ship_type").isNotNull()).join(F.broadcast(pooled), "_k")
    overall = F.col("_all") == 1
    take = ~overall & small
    return by_type.select(
        F.when(overall, POOLED).otherwise(F.col("ship_type")).alias("ship_type"),
        F.when(take, F.col("pa")).otherwise(F.col("a")).alias("intercept"),
        F.when(take, F.col("pb")).otherwise(F.col("b")).alias("displacement_exponent"),
        F.when(take, F.col("pn")).otherwise(F.col("n")).alias("speed_exponent"),
        F.when(overall | (F.col("usable") & ~small), F.col("valid"))
        .when(F.col("rows") < min_group_size, F.col("rows")).otherwise(F.col("pvalid")).alias("n_train"),
        (overall | small).alias("pooled"),
    )


def coefficient_table(coefficients: DataFrame) -> DataFrame:
    return coefficients.where(F.col("ship_type") != POOLED).select(
        "ship_type", F.round("intercept", 6).alias("intercept"),
        F.round("displacement_exponent", 4).alias("displacement_exponent"),
        F.round("speed_exponent", 4).alias("speed_exponent"), "n_train", "pooled",
    ).orderBy(F.desc("n_train"), "ship_type")


def predict(
    rows: DataFrame, coefficients: DataFrame, group: str = "ship_type", size: str = "cargo_carried_t",
    speed: str = "mean_speed_kn",
) -> DataFrame:
    """Add ``predicted_power_kw`` and ``cold_start`` (type not in training: pooled coefficients).

    Coefficients are one row per filed type, which is free text, so the size check decides how they are joined.
    """
    table = coefficients.where(F.col("ship_type") != POOLED).select(
        F.col("ship_type").alias("_type"), F.col("intercept").alias("_a"),
        F.col("displacement_exponent").alias("_b"), F.col("speed_exponent").alias("_n"))
    pooled = coefficients.where(F.col("ship_type") == POOLED).select(
        F.lit(1).alias("_k"), F.col("intercept").alias("_pa"),
        F.col("displacement_exponent").alias("_pb"), F.col("speed_exponent").alias("_pn"))
    joined = rows.join(table, F.col(group) == F.col("_type"), "left").withColumn("_k", F.lit(1)).join(
        F.broadcast(pooled), "_k")
    log_power = (
        F.coalesce("_a", "_pa") + F.coalesce("_b", "_pb") * _positive_log(size)
        + F.coalesce("_n", "_pn") * _positive_log(speed)
    )
    return joined.withColumns({
        "predicted_power_kw": F.exp(log_power), "cold_start": F.col("_type").isNull(),
    }).drop("_type", "_a", "_b", "_n", "_k", "_pa", "_pb", "_pn")
