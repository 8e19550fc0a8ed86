"""Optional: keep the panel current from a stream of filing drops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from bunkerline.sources import filings, panel_store

KEPT = ("file_order", "source_file", "report_coverage", "file_version")


def merge_drop(batch: DataFrame, target: str, stream: str = "", number: int | None = None) -> bool:
    """Fold one micro-batch into the panel at ``target`` as a new version of it.

    Only the periods the batch touches are read and rewritten, into folders of their own, so readers keep what they
    opened. The newest file version of a period wins, then the usual one-row-per-ship rule; both ignore order of arrival,
    and a replayed batch is left out by its number.
    """
    typed = filings.drop_blank(filings.typed_filings(filings.with_coverage(batch), KEPT)).withColumn(
        "file_version", F.col("file_version").cast("int"))
    return panel_store.merge(typed, target, stream, number)


def upsert_stream(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Watch ``source`` for CSV drops and merge each micro-batch into ``target``; read it by ``panel_store.read_panel``."""
    drops = spark.readStream.schema(schema).option("header", True).csv(source)
    return (
        drops.writeStream.foreachBatch(lambda batch, number: merge_drop(batch, target, checkpoint, number))
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )
