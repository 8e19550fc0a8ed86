"""Leakage-free model inputs and the target they must not see."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bunkerline import dims
from bunkerline import reference as ref
from bunkerline.functions.expr import bool_int, case_map


class ContaminatedFeatureError(ValueError):
    """A requested input shares a component with the target."""


def resolve_class(df: DataFrame, label: str = "ship_type", name: str = "vessel_class") -> DataFrame:
    """Canonical class of a free-text ship type; unknown and missing labels become the fallback."""
    aliases = dims.class_aliases(df.sparkSession).select(
        F.col("label").alias("_label"), F.col("vessel_class").alias("_found")
    )
    joined = df.join(F.broadcast(aliases), F.lower(F.trim(F.col(label))) == F.col("_label"), "left")
    return joined.withColumn(name, F.coalesce("_found", F.lit(ref.FALLBACK_CLASS))).drop("_label", "_found")


def unknown_labels(df: DataFrame, label: str = "ship_type") -> DataFrame:
    """Labels outside the vocabulary, once each, with the number of their rows."""
    aliases = dims.class_aliases(df.sparkSession)
    seen = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("rows"))
    return seen.join(F.broadcast(aliases), F.lower(F.trim(seen[label])) == aliases["label"], "left_anti")


def with_target(derived: DataFrame) -> DataFrame:
    """Energy per nautical mile: heating value times fuel per distance."""
    needed = {"inferred_lhv_mj_per_kg", "fuel_per_distance_kg_per_nmi"}
    absent = needed - set(derived.columns)
    if absent:
        raise KeyError(f"target needs {sorted(absent)}")
    return derived.withColumn(
        "target", F.col("inferred_lhv_mj_per_kg") * F.col("fuel_per_distance_kg_per_nmi")
    )


def contaminated(columns: Sequence[str]) -> list[str]:
    return sorted(set(columns) & set(ref.CONTAMINATED_COLUMNS))


def build_features(derived: DataFrame, extra: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """The eleven inputs, plus ``extra`` ones if they do not leak, plus ``keep`` columns as they are."""
    leaking = contaminated(extra)
    if leaking:
        raise ContaminatedFeatureError(f"{leaking} share a component with the target")
    absent = [c for c in extra if c not in derived.columns]
    if absent:
        raise KeyError(f"extra features not in the frame: {absent}")

    def optional(name: str, kind: str):
        return F.col(name) if name in derived.columns else F.lit(None).cast(kind)

    frame = resolve_class(derived)
    stated = optional("technical_efficiency_gco2_per_t_nmi", "double").cast("double")
    design = F.when(stated > 0, stated)
    metric = F.upper(F.trim(optional("technical_efficiency_metric", "string")))
    ice = F.upper(F.trim(optional("ice_class", "string")))
    return frame.select(
        *keep,
        "vessel_class",
        design.alias("design_efficiency_gco2_per_t_nmi"),
        design.isNotNull().cast("int").alias("has_design_efficiency"),
        *[bool_int(metric == m).alias(f"efficiency_metric_{m.lower()}") for m in ref.EFFICIENCY_METRICS],
        ice.isNotNull().cast("int").alias("has_ice_class"),
        F.coalesce(case_map(ice, ref.ICE_CLASS_ORDINAL).cast("double"), F.lit(0.0)).alias("ice_class_ordinal"),
        F.coalesce(optional("ice_time_share", "double"), F.lit(0.0)).alias("ice_time_share"),
        F.col("reporting_period").cast("double").alias("reporting_period"),
        F.col("time_at_sea_h").cast("double").alias("time_at_sea_h"),
        *extra,
    )


def class_columns() -> list[str]:
    return [f"class_{key}" for key in sorted(key for key, *_ in ref.CLASSES)]


def one_hot_classes(features: DataFrame) -> DataFrame:
    """One 0/1 column per declared class, whatever classes the data holds."""
    rest = [c for c in features.columns if c != "vessel_class"]
    return features.select(
        *rest, *[bool_int(F.col("vessel_class") == c[len("class_"):]).alias(c) for c in class_columns()]
    )
