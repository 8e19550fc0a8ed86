"""Range and cargo consequences of carrying a fuel in a given tank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bunkerline import reference as ref
from bunkerline.functions.expr import case_map
from bunkerline.operators.emissions import FUEL


def installed_density(fuel: str) -> float | None:
    """MJ per litre of installed tank system; none for electricity."""
    props = FUEL[fuel]
    if props["lhv"] is None or props["density"] is None:
        return None
    return props["lhv"] * props["density"] / 1000.0 / props["tank_factor"]


DENSITY = {f: d for f in FUEL if (d := installed_density(f)) is not None}


def density_of(fuel: Column) -> Column:
    return case_map(fuel, DENSITY).cast("double")


def usable_energy(volume_m3: Column, density: Column, usable: float = ref.TANK_USABLE) -> Column:
    return F.when(volume_m3 >= 0, volume_m3 * 1000.0 * density * usable)


def range_nmi(volume_m3: Column, intensity: Column, density: Column, reserve: float = ref.TANK_RESERVE) -> Column:
    return F.when(intensity > 0, usable_energy(volume_m3, density) / intensity * (1.0 - reserve))


def required_volume(
    route_nmi: Column, intensity: Column, density: Column,
    usable: float = ref.TANK_USABLE, reserve: float = ref.TANK_RESERVE,
) -> Column:
    energy = route_nmi * intensity / (1.0 - reserve)
    return F.when(route_nmi >= 0, energy / (density * 1000.0) / usable)


def plain_volume(energy_mj: Column, density: Column) -> Column:
    """Installed volume that holds the energy, without reserve or unusable share."""
    return energy_mj / density / 1000.0


def covers(range_column: Column, route_nmi: Column) -> Column:
    """Relative tolerance, so a tank sized for exactly this route passes."""
    return range_column >= route_nmi * (1.0 - 1e-9)


def cargo_displaced(
    route_nmi: Column, intensity: Column, density: Column, reference: Column,
    cargo_density: float = ref.CARGO_DENSITY,
) -> Column:
    extra = required_volume(route_nmi, intensity, density) - required_volume(route_nmi, intensity, reference)
    return F.greatest(F.lit(0.0), extra) * cargo_density


def assess(
    df: DataFrame, reference_fuel: str = "mgo", size_tank_for: str = "reference",
    volume: str | None = None, cargo_density: float = ref.CARGO_DENSITY,
) -> DataFrame:
    """Assess (fuel, route_nmi, energy_per_nmi_mj) rows.

    ``reference`` sizes the tank for the reference fuel (a retrofit), ``fuel`` for the row's own
    fuel (a newbuild); a ``volume`` column overrides both.
    """
    if size_tank_for not in ("reference", "fuel"):
        raise ValueError(f"size_tank_for must be reference or fuel, not {size_tank_for!r}")
    route, intensity = F.col("route_nmi"), F.col("energy_per_nmi_mj")
    density, reference = density_of(F.col("fuel")), F.lit(DENSITY[reference_fuel])
    sized = required_volume(route, intensity, reference if size_tank_for == "reference" else density)
    rows = df.withColumn("installed_m3", F.coalesce(F.col(volume), sized) if volume else sized)
    rows = rows.withColumns({
        "usable_energy_mj": usable_energy(F.col("installed_m3"), density),
        "range_nmi": range_nmi(F.col("installed_m3"), intensity, density),
        "needed_m3": required_volume(route, intensity, density),
        "cargo_displaced_t": cargo_displaced(route, intensity, density, reference, cargo_density),
    })
    rows = rows.withColumns({
        "feasible": covers(F.col("range_nmi"), route),
        "range_margin": F.when(route > 0, F.col("range_nmi") / route),
    })
    short = F.when(route > 0, 100.0 * (1.0 - F.col("range_nmi") / route)).otherwise(0.0)
    return rows.withColumn(
        "reason",
        F.when(F.col("feasible"), F.format_string(
            "range %s nmi covers the %s nmi leg", F.format_number("range_nmi", 0), F.format_number(route, 0))
        ).when(~F.col("feasible"), F.format_string(
            "range %s nmi falls %.0f%% short of the %s nmi leg: %s m3 needed, %s m3 installed",
            F.format_number("range_nmi", 0), short, F.format_number(route, 0), F.format_number("needed_m3", 0),
            F.format_number("installed_m3", 0))),
    )
