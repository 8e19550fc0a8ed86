"""Unit conversion to the canonical unit of a dimension; ambiguous tokens are refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bunkerline import dims
from bunkerline import reference as ref

HEADER_UNIT = r"[\(\[]([^)\]]+)[\)\]]\s*$"


def normal_token(token: Column) -> Column:
    bare = F.regexp_replace(F.trim(token), r"^[\[\]()]+|[\[\]()]+$", "")
    return F.trim(F.replace(bare, F.lit("³"), F.lit("^3")))


def with_unit_status(df: DataFrame, unit: str = "unit", dimension: str = "dimension") -> DataFrame:
    """Add ``unit_factor`` and ``unit_status`` (ok, ambiguous, unknown) with a reason."""
    spark = df.sparkSession
    table = dims.units(spark).select(
        F.col("dimension").alias("_d"), F.col("unit").alias("_u"), F.col("factor").alias("unit_factor"))
    unclear = dims.ambiguous_units(spark).select(F.col("token").alias("_t"), F.col("reason").alias("unit_reason"))
    rows = df.withColumn("_token", normal_token(F.col(unit)))
    rows = rows.join(F.broadcast(unclear), F.lower("_token") == F.col("_t"), "left")
    rows = rows.join(F.broadcast(table), (F.col("_token") == F.col("_u")) & (F.col(dimension) == F.col("_d")), "left")
    status = (
        F.when(F.col("_t").isNotNull(), "ambiguous").when(F.col("unit_factor").isNull(), "unknown").otherwise("ok")
    )
    return rows.withColumn("unit_status", status).drop("_token", "_t", "_d", "_u")


def to_canonical(df: DataFrame, value: str = "value", strict: bool = False) -> DataFrame:
    """Add ``canonical_value``; with ``strict`` the first refused row fails the job."""
    rows = with_unit_status(df)
    good = F.col("unit_status") == "ok"
    converted = F.when(good, F.col(value) * F.col("unit_factor") / F.lit(1.0))
    if strict:
        converted = converted.when(~good, F.raise_error(F.concat_ws(" ", "unit_status", F.lit("unit"), "unit")))
    return rows.withColumn("canonical_value", converted).drop("unit_factor")


def convert(value: Column, source: str, target: str, dimension: str) -> Column:
    """Fixed units known while planning: one multiplication."""
    table = ref.UNIT_FACTORS[dimension]
    return value * F.lit(table[source]) / F.lit(table[target])


def header_unit(df: DataFrame, header: str = "header", dimension: str = "header_dimension") -> DataFrame:
    """Add the unit written at the end of a header and its status; no unit is ``missing``."""
    found = F.regexp_extract(F.trim(header), HEADER_UNIT, 1)
    rows = with_unit_status(df.withColumn("header_unit", F.when(found != "", normal_token(found))), "header_unit", dimension)
    return rows.withColumn(
        "unit_status", F.when(F.col("header_unit").isNull(), "missing").otherwise(F.col("unit_status"))
    ).drop("unit_factor")


def kn_to_ms(knots: Column) -> Column:
    return knots / ref.KNOT_PER_MS


def ms_to_kn(mps: Column) -> Column:
    return mps * ref.KNOT_PER_MS
