"""Physical quantities reconstructed from a ship-year panel, with quality flags.

Pure projections: nothing is dropped, nothing is imputed, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bunkerline import reference as ref
from bunkerline.functions.expr import clip, ratio

BOUND_FLAGS = [f"flag_{name}_implausible" for name in ref.PLAUSIBLE]
EXTRA_FLAGS = ["flag_zero_fuel_while_sailing", "flag_negative_fuel"]
ALIAS_FLAG = "flag_co2_fuel_inconsistent"
CERTIFICATE = r"(?i)(EIV|EEDI|EEXI)\s*\(\s*([\d.]+)\s*g"


def blend(cf: Column) -> tuple[Column, Column]:
    """(LHV, share of the higher-Cf fuel) of the two-fuel blend that has this CO2 factor."""
    (_, c0, h0), (_, c1, h1), (_, c2, h2) = ref.BLEND_LADDER
    low = clip((cf - c0) / (c1 - c0), 0.0, 1.0)
    high = clip((cf - c1) / (c2 - c1), 0.0, 1.0)
    share = F.when(cf < c1, low).when(cf >= c1, high)
    lhv = F.when(cf < c1, h0 + low * (h1 - h0)).when(cf >= c1, h1 + high * (h2 - h1))
    return lhv, share


def with_distance_speed(panel: DataFrame) -> DataFrame:
    distance = ratio(F.col("total_fuel_t") * 1000.0, F.col("fuel_per_distance_kg_per_nmi"))
    return panel.withColumn("distance_nmi", distance).withColumn(
        "mean_speed_kn", ratio(F.col("distance_nmi"), F.col("time_at_sea_h"))
    )


def with_cargo(panel: DataFrame) -> DataFrame:
    per_nmi = F.col("fuel_per_distance_kg_per_nmi") * 1000.0
    mass = ratio(per_nmi, F.col("fuel_per_work_mass_g_per_t_nmi"))
    dwt = ratio(per_nmi, F.col("fuel_per_work_dwt_g_per_dwt_nmi"))
    return panel.withColumns({
        "cargo_carried_t": F.coalesce(mass, dwt),
        "cargo_basis": F.when(mass.isNotNull(), "mass").when(dwt.isNotNull(), "dwt").otherwise("none"),
    })


def with_energy(panel: DataFrame) -> DataFrame:
    """Needs distance; adds blend, energy, mean power and energy per mile."""
    cf = ratio(F.col("total_co2_t"), F.col("total_fuel_t"))
    out = panel.withColumn("implied_cf_t_per_t", cf)
    lhv, share = blend(F.col("implied_cf_t_per_t"))
    out = out.withColumns({"inferred_lhv_mj_per_kg": lhv, "inferred_blend_fraction": share})
    out = out.withColumn("energy_mj", F.col("total_fuel_t") * 1000.0 * F.col("inferred_lhv_mj_per_kg"))
    return out.withColumns({
        "mean_power_kw": ratio(F.col("energy_mj"), F.col("time_at_sea_h")) / 3.6,
        "energy_per_nmi_mj": ratio(F.col("energy_mj"), F.col("distance_nmi")),
    })


def with_shares(panel: DataFrame) -> DataFrame:
    ice = F.coalesce(F.col("time_at_sea_ice_h"), F.lit(0.0))
    return panel.withColumns({
        "berth_co2_share": ratio(F.col("co2_at_berth_t"), F.col("total_co2_t")),
        "laden_fuel_share": ratio(F.col("laden_fuel_t"), F.col("total_fuel_t")),
        "ice_time_share": ratio(ice, F.col("time_at_sea_h")),
    })


def with_certificate(panel: DataFrame) -> DataFrame:
    metric = F.upper(F.regexp_extract("technical_efficiency_raw", CERTIFICATE, 1))
    value = F.regexp_extract("technical_efficiency_raw", CERTIFICATE, 2)
    return panel.withColumns({
        "technical_efficiency_metric": F.when(metric != "", metric),
        "technical_efficiency_gco2_per_t_nmi": F.when(value != "", value).try_cast("double"),
        "has_ice_class": F.col("ice_class").isNotNull(),
    })


def with_flags(panel: DataFrame) -> DataFrame:
    def outside(name: str) -> Column:
        low, high = ref.PLAUSIBLE[name]
        return F.coalesce((F.col(name) < low) | (F.col(name) > high), F.lit(False))

    fuel, hours = F.col("total_fuel_t"), F.col("time_at_sea_h")
    flags = {flag: outside(name) for flag, name in zip(BOUND_FLAGS, ref.PLAUSIBLE)}
    flags["flag_zero_fuel_while_sailing"] = F.coalesce((hours > 0) & (fuel <= 0), F.lit(False))
    flags["flag_negative_fuel"] = F.coalesce(fuel < 0, F.lit(False))
    flags[ALIAS_FLAG] = flags[BOUND_FLAGS[0]]
    return panel.withColumns(flags)


def with_usable(panel: DataFrame) -> DataFrame:
    clean = F.lit(True)
    for flag in [*BOUND_FLAGS, *EXTRA_FLAGS, ALIAS_FLAG]:
        clean = clean & ~F.col(flag)
    measured = F.coalesce(F.col("mean_power_kw") > 0, F.lit(False)) & F.col("mean_speed_kn").isNotNull()
    return panel.withColumn("is_usable", clean & measured)


def derive_physics(panel: DataFrame) -> DataFrame:
    for step in (with_distance_speed, with_cargo, with_energy, with_shares, with_certificate, with_flags, with_usable):
        panel = step(panel)
    return panel


def quality_report(derived: DataFrame) -> DataFrame:
    """Long report (item, n): totals first, then flag counts, largest first.

    One aggregation over the panel; the rest works on its single row. The flag that only
    repeats the Cf flag is not counted again.
    """
    counted = [*BOUND_FLAGS, *EXTRA_FLAGS]
    totals = derived.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if("is_usable").alias("rows_usable"),
        F.count_if(F.col("distance_nmi").isNull()).alias("no_distance_reported"),
        F.count_if(F.col("cargo_basis") == "none").alias("no_cargo_reported"),
        *[F.count_if(flag).alias(flag) for flag in counted],
    ).withColumn(
        "usable_fraction",
        F.when(F.col("rows") > 0, F.round(F.col("rows_usable") / F.col("rows"), 4)).otherwise(0.0),
    )
    head = ["rows", "rows_usable", "usable_fraction", "no_distance_reported", "no_cargo_reported"]
    items = F.array(*[
        F.struct(F.lit(section).alias("section"), F.lit(name).alias("item"), F.col(name).cast("double").alias("n"))
        for section, names in (("total", head), ("flag", counted)) for name in names
    ])
    return (
        totals.select(F.explode(items).alias("i")).select("i.*")
        .where((F.col("section") == "total") | (F.col("n") > 0))
        .orderBy(F.desc("section"), F.desc("n"), "item")
    )


def power_identity(usable: DataFrame) -> DataFrame:
    """Largest relative gap between power and LHV x fuel per mile x speed."""
    other = F.col("inferred_lhv_mj_per_kg") * F.col("fuel_per_distance_kg_per_nmi") * F.col("mean_speed_kn") / 3.6
    gap = F.abs(F.col("mean_power_kw") - other) / F.col("mean_power_kw")
    return usable.agg(F.count(gap).alias("rows"), F.max(gap).alias("max_relative_gap"))
