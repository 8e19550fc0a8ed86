"""A panel that changes period by period while it is read.

Every write goes to a folder of its own; a small numbered manifest names the folders that make up one version and is put in
place by a rename that fails if another writer took the number. A reader opens the folders of one manifest, so it never sees
half a period, and folders it reads are only deleted by ``expire``.

Two levels are kept. ``files`` holds, for each period named by file names, the best row a ship has for each year its files
report (cells may name another year than the file). ``panel`` holds, for each reported year, the best of those rows over all
files. If the files of a period change, its first level is rebuilt from them and of the second only the years that its old or
new rows report.

The manifest grows with the number of reporting years, not with rows. Rows without ship or fuel are left out, rows without a
year stay together under none. No files: an empty list of changes, and no version if there was none.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bunkerline.sources import filings
from bunkerline.sources.drops import read_drops

NO_YEAR = "none"
ORDER = "drop_order"
KEPT = (ORDER, "source_path", "file_period", "report_coverage", "file_version")


class VersionTaken(RuntimeError):
    """Another writer published this version first; read it and try again."""


@dataclass
class Manifest:
    version: int = 0
    files: dict[str, dict] = field(default_factory=dict)  # file period -> folder, fingerprint, years
    panel: dict[str, str] = field(default_factory=dict)  # reported year -> folder
    batches: dict[str, int] = field(default_factory=dict)  # stream -> last batch that is in


class _Store:
    """Paths of one panel, through the Hadoop file system its address names."""

    def __init__(self, spark: SparkSession, root: str):
        jvm = spark._jvm
        self.spark, self.root, self._fs = spark, root.rstrip("/"), jvm.org.apache.hadoop.fs
        at = self._fs.Path(self.root)
        conf = spark._jsc.hadoopConfiguration()
        self.fs = at.getFileSystem(conf)
        self.context = self._fs.FileContext.getFileContext(self.fs.getUri(), conf)
        kind = getattr(jvm, "org.apache.hadoop.fs.Options$Rename")
        self.plain = spark.sparkContext._gateway.new_array(kind, 1)
        self.plain[0] = kind.NONE

    def path(self, *parts: str):
        return self._fs.Path("/".join((self.root, *parts)))

    def versions(self) -> list[int]:
        folder = self.path("manifests")
        if not self.fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in self.fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def load(self, version: int) -> Manifest:
        stream = self.fs.open(self.path("manifests", f"{version:012d}.json"))
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return Manifest(**json.loads(text))

    def publish(self, manifest: Manifest) -> None:
        self.fs.mkdirs(self.path("manifests"))
        draft = self.path("manifests", f".{uuid.uuid4().hex}")
        stream = self.fs.create(draft, False)
        stream.write(json.dumps(asdict(manifest), sort_keys=True).encode())
        stream.close()
        try:
            self.context.rename(self.fs.makeQualified(draft), self.fs.makeQualified(self.path("manifests", f"{manifest.version:012d}.json")), self.plain)
        except Exception as failed:
            self.fs.delete(draft, False)
            if "FileAlreadyExists" in str(failed):
                raise VersionTaken(f"{self.root}: version {manifest.version} exists") from None
            raise

    def newest(self) -> Manifest | None:
        found = self.versions()
        return self.load(found[-1]) if found else None


def current(spark: SparkSession, root: str) -> Manifest | None:
    return _Store(spark, root).newest()


def _year() -> Column:
    return F.coalesce(F.col("reporting_period").cast("string"), F.lit(NO_YEAR))


def _write(rows: DataFrame, root: str, level: str) -> dict[str, str]:
    """Rows under a folder of their own, split by ``_part``: folder of each part."""
    build = uuid.uuid4().hex
    folder = f"{root.rstrip('/')}/{level}/{build}"
    rows.hint("rebalance", "_part").write.partitionBy("_part").parquet(folder)
    done = rows.sparkSession.read.option("recursiveFileLookup", True).format("binaryFile").load(folder).select(
        F.regexp_extract("path", r"/_part=([^/]+)/", 1).alias("part")).where("part <> ''").distinct().collect()  # a few years
    return {r["part"]: f"{level}/{build}/_part={r['part']}" for r in done}


def _open(spark: SparkSession, root: str, folders: Iterable[str]) -> DataFrame | None:
    paths = sorted({f"{root.rstrip('/')}/{f}" for f in folders})
    return spark.read.parquet(*paths) if paths else None


def read_panel(spark: SparkSession, root: str, periods: Iterable[int | None] | None = None, version: int | None = None) -> DataFrame:
    """The panel as of one version (the newest one by default), only the folders of the periods asked for."""
    store = _Store(spark, root)
    held = store.load(version) if version is not None else store.newest()
    if held is None:
        raise FileNotFoundError(f"{root}: no version published")
    wanted = None if periods is None else {NO_YEAR if p is None else str(p) for p in periods}
    found = [f for year, f in held.panel.items() if wanted is None or year in wanted]
    rows = _open(spark, root, found)
    if rows is None:
        folder = next(iter(held.panel.values()), None)
        if folder is None:
            raise FileNotFoundError(f"{root}: version {held.version} holds no rows")
        rows = _open(spark, root, [folder]).where(F.lit(False))
    return rows


def fingerprints(spark: SparkSession, path: str) -> dict[str, str]:
    """Per file period a mark of its files' names, sizes and times; the files are listed, not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(F.col("path").rlike(r"\.(csv|parquet)$"))
    inside = F.expr("substring(path, length({}) + 1)".format("'" + _qualified(spark, path).replace("'", "''") + "'"))
    year = F.regexp_extract(inside, filings.PERIOD_PATTERN, 0)
    mark = F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")
    found = files.select(F.when(year != "", year).otherwise(NO_YEAR).alias("period"), mark.alias("m")).groupBy("period").agg(
        F.count(F.lit(1)).alias("n"), F.sum("m").alias("m")).collect()  # one row a period
    return {r["period"]: f"{r['n']}:{r['m']}" for r in found}


def _qualified(spark: SparkSession, path: str) -> str:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()


def best_rows(text: DataFrame, coverage: str = "full") -> DataFrame:
    """Typed rows of the newest file version of each file period, one for each ship and reported year.

    A file without a coverage column holds full years.
    """
    covered = text.withColumn("report_coverage", F.coalesce("report_coverage", F.lit("full")))
    placed = filings.with_coverage(covered, coverage).withColumn("_period", F.coalesce("file_period", F.lit(-1)))  # null never joins
    typed = filings.typed_filings(filings.latest_version(placed, "_period", "file_version"), KEPT)
    typed = typed.withColumn("reporting_period", F.coalesce("reporting_period", F.col("file_period")))
    return filings.deduplicate(filings.drop_blank(typed), ("file_period", "imo", "reporting_period"), ORDER)


def _merge_years(spark: SparkSession, root: str, held: Manifest, years: set[str]) -> None:
    """Rebuild the given years of the second level from the first."""
    folders = [f["folder"] for f in held.files.values() if f["folder"] and years & set(f["years"])]
    rows = _open(spark, root, folders)
    for year in years:
        held.panel.pop(year, None)
    if rows is None:
        return
    rows = rows.where(_year().isin(sorted(years)))
    panel = filings.deduplicate(rows, ("imo", "reporting_period"), ORDER).withColumn("_part", _year())
    held.panel |= _write(panel, root, "panel")


def _years_of(spark: SparkSession, root: str, folder: str) -> list[str]:
    return sorted(r[0] for r in _open(spark, root, [folder]).select(_year().alias("y")).distinct().collect())


def refresh(spark: SparkSession, path: str, root: str, coverage: str = "full") -> list[str]:
    """Bring the panel at ``root`` up to the drops under ``path``; returns the file periods that were rebuilt or removed."""
    store = _Store(spark, root)
    held = store.newest() or Manifest()
    marks = fingerprints(spark, path)
    changed = sorted(p for p in marks.keys() | held.files.keys() if marks.get(p) != held.files.get(p, {}).get("fingerprint"))
    if not changed:
        return []
    years = {y for p in changed for y in held.files.pop(p, {"years": []})["years"]}
    rebuilt = [p for p in changed if p in marks]
    if rebuilt:
        numbers = [int(p) for p in rebuilt if p != NO_YEAR]
        text = read_drops(spark, path, keep=("report_coverage",))
        wanted = F.col("file_period").isin(numbers) if NO_YEAR not in rebuilt else F.col("file_period").isNull() | F.col("file_period").isin(numbers)
        rows = best_rows(text.where(wanted), coverage).withColumn("_part", F.coalesce(F.col("file_period").cast("string"), F.lit(NO_YEAR)))
        folders = _write(rows, root, "files")
        for p in rebuilt:
            if p in folders:
                held.files[p] = {"folder": folders[p], "fingerprint": marks[p], "years": _years_of(spark, root, folders[p])}
                years |= set(held.files[p]["years"])
            else:  # files without a usable row
                held.files[p] = {"folder": "", "fingerprint": marks[p], "years": []}
    _merge_years(spark, root, held, years)
    held.version += 1
    store.publish(held)
    return changed


def merge(typed: DataFrame, root: str, stream: str = "", batch: int | None = None) -> bool:
    """Fold new rows into the panel's years; rows carry ``file_version``, and the newest one of a year wins.

    A batch that is already in (by stream and number) changes nothing. The result does not depend on the order of batches.
    Use either this or ``refresh`` on a panel: rows merged here have no files to be rebuilt from.
    """
    spark = typed.sparkSession
    store = _Store(spark, root)
    held = store.newest() or Manifest()
    if batch is not None and held.batches.get(stream, -1) >= batch:
        return False
    new = _write(typed.withColumn("_part", _year()), root, "arrivals")
    if new:
        parts = [held.panel[y] for y in new if y in held.panel]
        rows = _open(spark, root, new.values())
        if parts:
            rows = rows.unionByName(_open(spark, root, parts).select(*rows.columns))
        newest = rows.groupBy(_year().alias("_y")).agg(F.max("file_version").alias("_v"))
        rows = rows.withColumn("_y", _year()).join(F.broadcast(newest), "_y").where(F.col("file_version").eqNullSafe(F.col("_v"))).drop("_y", "_v")
        held.panel |= _write(filings.deduplicate(rows).withColumn("_part", _year()), root, "panel")
    if batch is not None:
        held.batches[stream] = batch
    held.version += 1
    store.publish(held)
    return True


def expire(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Delete folders that none of the last ``keep`` versions names, and older manifests; returns the folders.

    For times without a writer: a build that is not published yet is named by no version.
    """
    store = _Store(spark, root)
    versions = store.versions()
    stay = versions[-max(keep, 1):]
    named = set()
    for v in stay:
        held = store.load(v)
        named |= {f["folder"] for f in held.files.values()} | set(held.panel.values())
    gone = []
    for level in ("files", "panel", "arrivals"):
        if not store.fs.exists(store.path(level)):
            continue
        for build in [b.getPath().getName() for b in store.fs.listStatus(store.path(level))]:
            parts = [p.getPath().getName() for p in store.fs.listStatus(store.path(level, build))]
            used = [p for p in parts if f"{level}/{build}/{p}" in named]
            for part in parts:
                if part.startswith("_part=") and part not in used:
                    store.fs.delete(store.path(level, build, part), True)
                    gone.append(f"{level}/{build}/{part}")
            if not used:
                store.fs.delete(store.path(level, build), True)
    for v in versions[: -max(keep, 1)]:
        store.fs.delete(store.path("manifests", f"{v:012d}.json"), False)
    return gone
