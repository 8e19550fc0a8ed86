"""Writing the panel and provenance records."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bunkerline import __version__
from bunkerline import reference as ref
from bunkerline.session import shared_dir


def write_panel(panel: DataFrame, path: str | None = None) -> str:
    """Parquet partitioned by period, so a period filter prunes directories.

    Rows are brought together by period first, so that not every task opens a file in every partition;
    the rebalance splits a large period by its size.
    """
    path = path or f"{shared_dir(panel.sparkSession)}/panel-{uuid.uuid4().hex}"
    panel.hint("rebalance", "reporting_period").write.mode("overwrite").partitionBy("reporting_period").parquet(path)
    return path


def digest(*columns: str):
    """16 hex digits over the canonical JSON of the named columns, in name order."""
    body = F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})
    return F.substring(F.sha2(body, 256), 1, 16)


def run_context(inputs: DataFrame, seed: int, stage: str) -> DataFrame:
    """One provenance row: what ran, on what, with a digest of the inputs."""
    return inputs.select(
        F.lit(seed).alias("seed"), F.lit(stage).alias("stage"), F.lit(__version__).alias("package_version"),
        F.version().alias("engine_version"), F.to_json(F.struct(*sorted(inputs.columns))).alias("inputs"),
        digest(*inputs.columns).alias("input_digest"), F.current_timestamp().alias("started_at"),
    )


def write_json(record: DataFrame, path: str) -> None:
    record.write.mode("overwrite").json(path)


def model_card(training: DataFrame, params: dict | None = None, held_out: DataFrame | None = None) -> DataFrame:
    """One row on a trained model: sizes, periods, features, settings, interval method, and all of it as JSON.

    ``held_out`` is one row of metrics from rows the model did not see; they join the card under their own names.
    """
    # the period set is small (one entry per reporting year), so it may live in one buffer
    card = training.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("imo").alias("n_ships"),
        F.array_join(F.array_sort(F.collect_set(F.col("reporting_period").cast("string"))), ",").alias("periods"),
    ).select(
        "*", F.lit(len(ref.MODEL_FEATURES)).alias("n_features"),
        F.lit(",".join(ref.MODEL_FEATURES)).alias("features"),
        F.lit(json.dumps(params or {}, sort_keys=True)).alias("params"),
        F.lit("grouped out-of-fold log residuals").alias("interval_method"),
    )
    parts = [F.col(c) for c in card.columns]
    if held_out is not None:
        card = card.crossJoin(held_out.select(F.struct(*held_out.columns).alias("held_out")))  # one row each
        parts.append(F.col("held_out"))
    return card.withColumn("card", F.to_json(F.struct(*parts)))
