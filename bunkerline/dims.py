"""Reference tables: small constant DataFrames joined to by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bunkerline import reference as ref
from bunkerline.functions.expr import inline_table


def fuels(spark: SparkSession) -> DataFrame:
    return inline_table(spark, ref.FUEL_COLUMNS, ref.FUELS)


def pathways(spark: SparkSession) -> DataFrame:
    return inline_table(spark, ref.PATHWAY_COLUMNS, ref.PATHWAYS)


def pilots(spark: SparkSession) -> DataFrame:
    return inline_table(spark, ref.PILOT_COLUMNS, ref.PILOTS)


def slips(spark: SparkSession) -> DataFrame:
    return inline_table(spark, ref.SLIP_COLUMNS, ref.SLIPS)


def slip_ranges(spark: SparkSession) -> DataFrame:
    return inline_table(spark, ref.SLIP_RANGE_COLUMNS, ref.SLIP_RANGES)


def gwp_sets(spark: SparkSession) -> DataFrame:
    return inline_table(spark, ref.GWP_COLUMNS, ref.GWP_SETS)


def ports(spark: SparkSession) -> DataFrame:
    return inline_table(spark, ref.PORT_COLUMNS, ref.PORTS)


def availability(spark: SparkSession) -> DataFrame:
    return inline_table(spark, ref.AVAILABILITY_COLUMNS, ref.AVAILABILITY)


def shore_power(spark: SparkSession) -> DataFrame:
    return inline_table(spark, ref.SHORE_POWER_COLUMNS, ref.SHORE_POWER)


def class_rows() -> list[tuple[str, str, float, float, bool]]:
    return [(key, name, speed, aux, scope) for key, name, speed, aux, scope, _ in ref.CLASSES]


def classes(spark: SparkSession) -> DataFrame:
    return inline_table(
        spark,
        "vessel_class string, display_name string, reference_speed_kn double, aux_share double, in_scope boolean",
        class_rows(),
    )


def alias_rows() -> list[tuple[str, str]]:
    claimed: dict[str, str] = {}
    for key, name, _, _, _, extra in ref.CLASSES:
        for label in (key, name, *extra):
            owner = claimed.setdefault(label.strip().lower(), key)
            if owner != key:
                raise ValueError(f"label {label!r} belongs to both {owner!r} and {key!r}")
    return sorted(claimed.items())


def class_aliases(spark: SparkSession) -> DataFrame:
    return inline_table(spark, "label string, vessel_class string", alias_rows())


def units(spark: SparkSession) -> DataFrame:
    rows = [(d, u, f) for d, table in ref.UNIT_FACTORS.items() for u, f in table.items()]
    return inline_table(spark, "dimension string, unit string, factor double", rows)


def ambiguous_units(spark: SparkSession) -> DataFrame:
    return inline_table(spark, "token string, reason string", sorted(ref.AMBIGUOUS_UNITS.items()))


def filing_columns(spark: SparkSession) -> DataFrame:
    rows = [(n, h, d, u, r) for n, h, d, u, r, _ in ref.FILING_COLUMNS]
    return inline_table(
        spark, "name string, header string, dimension string, unit string, required boolean", rows
    )


def median(values: list[float]) -> float:
    ordered = sorted(values)
    middle = len(ordered) // 2
    return ordered[middle] if len(ordered) % 2 else (ordered[middle - 1] + ordered[middle]) / 2


TABLES = {
    "fuels": fuels, "pathways": pathways, "pilots": pilots, "slips": slips,
    "slip_ranges": slip_ranges, "gwp_sets": gwp_sets, "ports": ports,
    "availability": availability, "shore_power": shore_power, "classes": classes,
    "class_aliases": class_aliases, "units": units, "ambiguous_units": ambiguous_units,
    "filing_columns": filing_columns,
}


def register_views(spark: SparkSession, prefix: str = "dim_") -> list[str]:
    """Expose every reference table to SQL users."""
    for name, build in TABLES.items():
        build(spark).createOrReplaceTempView(prefix + name)
    return [prefix + name for name in TABLES]


def violations(
    fuel_dim: DataFrame, pathway_dim: DataFrame, pilot_dim: DataFrame, slip_dim: DataFrame,
    alias_dim: DataFrame, gwp_dim: DataFrame, active_gwp: str,
) -> DataFrame:
    """Integrity rules as one violation list (rule, subject); empty means the tables agree."""

    def rule(name: str, rows: DataFrame, subject) -> DataFrame:
        return rows.select(F.lit(name).alias("rule"), subject.cast("string").alias("subject"))

    engines = slip_dim.select("fuel", F.col("engine").alias("default_engine"))
    slip_fuels = slip_dim.select("fuel").distinct()
    targets = pathway_dim.select(
        F.col("fuel").alias("pilot_fuel"), F.col("pathway").alias("pilot_pathway")
    )
    checks = [
        rule("combustible_without_lhv",
             fuel_dim.where(~F.col("is_carrier") & F.col("lhv").isNull()), F.col("fuel")),
        rule("slip_without_listed_default_engine",
             fuel_dim.join(slip_fuels, "fuel", "left_semi").join(
                 engines, ["fuel", "default_engine"], "left_anti"), F.col("fuel")),
        rule("pilot_share_outside_0_1",
             pilot_dim.where((F.col("pilot_fraction") < 0) | (F.col("pilot_fraction") >= 1)),
             F.col("fuel")),
        rule("pilot_is_itself", pilot_dim.where(F.col("fuel") == F.col("pilot_fuel")), F.col("fuel")),
        rule("pilot_pathway_unknown",
             pilot_dim.join(targets, ["pilot_fuel", "pilot_pathway"], "left_anti"), F.col("fuel")),
        rule("pathway_of_unknown_fuel",
             pathway_dim.join(fuel_dim, "fuel", "left_anti"), F.col("fuel")),
        rule("alias_claimed_twice",
             alias_dim.groupBy("label").agg(F.count_distinct("vessel_class").alias("n")).where("n > 1"),
             F.col("label")),
        rule("gwp_set_missing",
             gwp_dim.agg(F.max((F.col("gwp_set") == active_gwp).cast("int")).alias("ok"))
             .where("coalesce(ok, 0) = 0"), F.lit(active_gwp)),
    ]
    return reduce(DataFrame.unionByName, checks)
