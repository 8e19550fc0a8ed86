"""Emission-intensity targets per tonne of cargo, and carbon cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bunkerline import reference as ref
from bunkerline.functions.expr import piecewise_linear


def required_reduction(year: Column) -> Column:
    """Share below baseline: zero up to the baseline year, linear between targets, then flat."""
    return piecewise_linear(year, {ref.POLICY_BASELINE_YEAR: 0.0, **ref.POLICY_TARGETS})


def assess(df: DataFrame) -> DataFrame:
    """Assess (year, emissions_t, cargo_t, baseline_intensity) rows; no cargo gives nulls."""
    valid = (F.col("cargo_t") > 0) & (F.col("baseline_intensity") > 0)
    rows = df.withColumns({
        "current_intensity": F.when(valid, F.col("emissions_t") / F.col("cargo_t")),
        "required_reduction": F.when(valid, required_reduction(F.col("year"))),
    })
    rows = rows.withColumns({
        "required_intensity": F.col("baseline_intensity") * (1.0 - F.col("required_reduction")),
        "achieved_reduction": 1.0 - F.col("current_intensity") / F.col("baseline_intensity"),
    })
    short = F.col("required_reduction") - F.col("achieved_reduction")
    return rows.withColumns({
        "on_track": F.col("achieved_reduction") >= F.col("required_reduction") - 1e-12,
        "gap": F.when(short < 1e-12, 0.0).otherwise(short),
        "headroom_intensity": F.greatest(F.lit(0.0), F.col("current_intensity") - F.col("required_intensity")),
    })


def glide_path(df: DataFrame, key: str, first: int, last: int) -> DataFrame:
    """Required intensity per key and year from each key's ``baseline_intensity``."""
    years = df.select(key, "baseline_intensity", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("year"))
    return years.withColumn(
        "required_intensity", F.col("baseline_intensity") * (1.0 - required_reduction(F.col("year")))
    )


def carbon_cost(emissions_t: Column, price: Column) -> Column:
    return F.when((emissions_t >= 0) & (price >= 0), emissions_t * price)
