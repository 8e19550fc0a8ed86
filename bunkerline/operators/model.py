"""Energy model scoring: a level per vessel, imposed speed physics, calibrated intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bunkerline import dims
from bunkerline import reference as ref
from bunkerline.functions.expr import case_map
from bunkerline.operators.emissions import FUEL

DEFAULT_SPEED = dims.median([c[2] for c in ref.CLASSES])
DEFAULT_AUX = dims.median([c[3] for c in ref.CLASSES])
COMBUSTIBLE = [f for f in FUEL if not FUEL[f]["is_carrier"]]
CUBE = 3.0
LOAD_EXPONENT = 2.0 / 3.0


def reference_points(df: DataFrame) -> DataFrame:
    """Add the class reference speed and auxiliary share; an unlisted class gets the medians."""
    speeds = {c[0]: c[2] for c in ref.CLASSES}
    shares = {c[0]: c[3] for c in ref.CLASSES}
    cls = F.col("vessel_class")
    return df.withColumns({
        "reference_speed_kn": F.coalesce(case_map(cls, speeds).cast("double"), F.lit(DEFAULT_SPEED)),
        "aux_share": F.coalesce(case_map(cls, shares).cast("double"), F.lit(DEFAULT_AUX)),
    })


def power_kw(intensity: Column, reference_speed: Column, aux: Column, speed: Column, load: Column) -> Column:
    """Auxiliary share constant, the rest cubic in speed and 2/3 in displacement."""
    at_reference = intensity * reference_speed / 3.6
    return at_reference * ((1.0 - aux) * F.pow(load, LOAD_EXPONENT) * F.pow(speed / reference_speed, CUBE) + aux)


def energy_per_nmi(power: Column, speed: Column) -> Column:
    """Null at rest, where energy per mile is unbounded."""
    return F.when(speed > ref.MIN_SPEED_KN, power * 3.6 / speed)


def class_mean_intensity(features: DataFrame, levels: DataFrame) -> DataFrame:
    """Add ``intensity``: exp of the class mean log target, or of the global mean if unseen.

    ``levels`` is the class_levels table: at most one row per declared class, so broadcast.
    """
    known = levels.where(F.col("is_global") == 0).select(
        F.col("vessel_class").alias("_c"), F.col("log_level").alias("_l"))
    overall = levels.where(F.col("is_global") == 1).select(F.lit(1).alias("_k"), F.col("log_level").alias("_g"))
    joined = features.join(F.broadcast(known), F.col("vessel_class") == F.col("_c"), "left").withColumn(
        "_k", F.lit(1)).join(F.broadcast(overall), "_k")
    return joined.withColumns({
        "intensity": F.exp(F.coalesce("_l", "_g")), "unseen_class": F.col("_c").isNull(),
    }).drop("_c", "_l", "_k", "_g")


def cold_start() -> Column:
    """No certificate, or a class without training rows."""
    return F.col("unseen_class") | F.col("design_efficiency_gco2_per_t_nmi").isNull()


def band_table(bands: DataFrame) -> DataFrame:
    """Bands per declared class: its own or the global one, beside the cold band."""
    keyed = dims.classes(bands.sparkSession).select("vessel_class", F.lit(1).alias("_k"))
    own = bands.where("scope = 'class'").select("vessel_class", F.col("low").alias("_cl"), F.col("high").alias("_ch"))
    shared = bands.where("scope in ('global', 'cold')").groupBy(F.lit(1).alias("_k")).agg(*[
        F.max(F.when(F.col("scope") == scope, F.col(side))).alias(f"{scope}_{side}")
        for scope in ("global", "cold") for side in ("low", "high")
    ])
    return keyed.join(F.broadcast(shared), "_k").join(F.broadcast(own), "vessel_class", "left").select(
        "vessel_class", F.coalesce("_cl", "global_low").alias("band_low"),
        F.coalesce("_ch", "global_high").alias("band_high"), "cold_low", "cold_high",
    )


def interval(energy: Column, speed: Column, reference_speed: Column, cold: Column) -> tuple[Column, Column]:
    """(P10, P90): bands widen away from the reference speed, and cold rows take the wider band."""
    floor = F.greatest(speed / reference_speed, ref.MIN_SPEED_KN / reference_speed)
    widening = 1.0 + ref.EXTRAPOLATION_WIDENING * F.abs(F.ln(floor))
    scaled_low, scaled_high = F.col("band_low") * ref.COLD_WIDENING, F.col("band_high") * ref.COLD_WIDENING
    low = F.when(cold, F.least(scaled_low, F.col("cold_low"))).otherwise(F.col("band_low"))
    high = F.when(cold, F.greatest(scaled_high, F.col("cold_high"))).otherwise(F.col("band_high"))
    return energy * F.exp(low * widening), energy * F.exp(high * widening)


def extrapolating(speed: Column, reference_speed: Column) -> Column:
    lo, hi = ref.EXTRAPOLATION_BAND
    return (speed / reference_speed < lo) | (speed / reference_speed > hi)


def predict(
    scored: DataFrame, bands: DataFrame, speed: str | None = None, load_ratio: float | str = 1.0,
) -> DataFrame:
    """Add power, energy per mile with P10/P90 and flags to rows that carry ``intensity``.

    Without a ``speed`` column each row is evaluated at its class reference speed.
    """
    rows = reference_points(scored).join(F.broadcast(band_table(bands)), "vessel_class", "left")
    load = F.col(load_ratio) if isinstance(load_ratio, str) else F.lit(float(load_ratio))
    at = F.col(speed) if speed else F.col("reference_speed_kn")
    rows = rows.withColumns({
        "speed_kn": F.when(at >= 0, at),
        "cold_start": cold_start(),
        "power_kw": F.when(load > 0, power_kw(
            F.col("intensity"), F.col("reference_speed_kn"), F.col("aux_share"), F.when(at >= 0, at), load)),
    })
    rows = rows.withColumn("predicted_energy_per_nmi_mj", energy_per_nmi(F.col("power_kw"), F.col("speed_kn")))
    p10, p90 = interval(
        F.col("predicted_energy_per_nmi_mj"), F.col("speed_kn"), F.col("reference_speed_kn"), F.col("cold_start"))
    return rows.withColumns({
        "p10": p10, "p90": p90, "extrapolating": extrapolating(F.col("speed_kn"), F.col("reference_speed_kn")),
    }).drop("band_low", "band_high", "cold_low", "cold_high")


def speed_curves(scored: DataFrame) -> DataFrame:
    """One closed-form curve per row: the level is scored once, speed costs arithmetic only."""
    return reference_points(scored).withColumnRenamed("intensity", "reference_intensity_mj_per_nmi").withColumn(
        "cold_start", cold_start())


def speed_sweep(
    scored: DataFrame, bands: DataFrame, keep: Sequence[str], points: int = 26, speeds: Sequence[float] | None = None,
    fuels: Sequence[str] = tuple(COMBUSTIBLE), load_ratio: float = 1.0,
) -> DataFrame:
    """Each vessel on a speed grid (0 to 1.25 x reference, or given), with tonnes of fuel per 1,000 nmi."""
    rows = reference_points(scored)
    if speeds is None:
        step = F.col("reference_speed_kn") * 1.25 / (points - 1)
        grid = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: i * step)
    else:
        grid = F.array(*[F.lit(float(s)) for s in speeds])
    swept = rows.select("*", F.posexplode(grid).alias("point", "grid_speed_kn")).drop("reference_speed_kn", "aux_share")
    out = predict(swept, bands, "grid_speed_kn", load_ratio)
    mass = F.map_from_arrays(
        F.array(*[F.lit(f) for f in fuels]),
        F.array(*[
            F.col("predicted_energy_per_nmi_mj") * 1000.0 / FUEL[f]["efficiency"] / FUEL[f]["lhv"] / 1000.0 for f in fuels
        ]),
    )
    return out.withColumn("fuel_t_per_1000_nmi", mass).select(
        *keep, "point", "speed_kn", "predicted_energy_per_nmi_mj", "p10", "p90", "power_kw", "extrapolating",
        "cold_start", "fuel_t_per_1000_nmi",
    )


def optimal_speed(reference_speed: Column, aux: Column, load: Column) -> Column:
    """Speed with the least energy per mile."""
    return reference_speed * F.cbrt(aux / (2.0 * (1.0 - aux) * F.pow(load, LOAD_EXPONENT)))


def check_monotone_speed(scored: DataFrame, low: int = 4, high: int = 24) -> DataFrame:
    """Add the number of speed steps at which power falls; the sweep stays inside the row."""
    rows = reference_points(scored)
    powers = F.transform(F.sequence(F.lit(low), F.lit(high)), lambda v: power_kw(
        F.col("intensity"), F.col("reference_speed_kn"), F.col("aux_share"), v.cast("double"), F.lit(1.0)))
    rows = rows.withColumn("_powers", powers)
    falls = F.filter(
        F.sequence(F.lit(1), F.lit(high - low)),
        lambda i: F.element_at("_powers", i + 1) - F.element_at("_powers", i) < -1e-9,
    )
    return rows.withColumn("falls", F.size(falls)).drop("_powers")


def check_zero_speed(scored: DataFrame) -> DataFrame:
    """Add power at rest and whether it is finite and positive."""
    rows = reference_points(scored)
    rest = power_kw(F.col("intensity"), F.col("reference_speed_kn"), F.col("aux_share"), F.lit(0.0), F.lit(1.0))
    return rows.withColumn("rest_power_kw", rest).withColumn(
        "rest_ok", F.coalesce((F.col("rest_power_kw") > 0) & (F.col("rest_power_kw") < float("inf")), F.lit(False)))
