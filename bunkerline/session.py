"""Session helpers for local runs, tests and the benchmark."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

_fallback: dict[str, str] = {}


def local_session(cores: str = "*", memory: str = "12g", name: str = "bunkerline") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only on a local master where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _fallback:
            _fallback[app] = tempfile.mkdtemp(prefix="bunkerline-shared-")
        named = _fallback[app]
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise to the shared folder so lost executors do not replay the whole history."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def tune(spark: SparkSession) -> None:
    """Session settings the wide projections need.

    The JVM does not compile methods above 8,000 bytecodes; a fused stage over dozens of text
    columns passes that and would run interpreted. Below the limit Spark splits it instead.
    """
    if spark.conf.get("spark.sql.codegen.hugeMethodLimit", "65535") == "65535":
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
