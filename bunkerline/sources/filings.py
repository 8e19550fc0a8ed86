"""Reading annual filings whose headers drift between reporting periods."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bunkerline import reference as ref
from bunkerline.functions.expr import as_category, as_number, cell_kind

# fixed values: characters folded by hand because NFKC leaves them alone
FOLDED = {"·": ".", "–": "-", "—": "-", " ": " "}
PERIOD_PATTERN = r"(19|20)\d{2}"


class FilingSchemaError(ValueError):
    """A filing does not carry the columns every period must have."""


def fold_header(header: str | None) -> str:
    text = unicodedata.normalize("NFKC", header or "")
    text = text.translate(str.maketrans(FOLDED))
    return " ".join(text.split()).lower()


@dataclass(frozen=True)
class HeaderMap:
    """Where each declared column comes from in one published layout."""

    source: dict[str, str]
    via_alias: dict[str, str] = field(default_factory=dict)
    missing_optional: tuple[str, ...] = ()
    unconsumed: tuple[str, ...] = ()


def resolve_headers(published: Sequence[str]) -> HeaderMap:
    """Match headers by folded text: primary first, then aliases; never by position."""
    by_key: dict[str, str] = {}
    for header in published:
        by_key.setdefault(fold_header(header), header)
    source, via_alias, absent, required = {}, {}, [], []
    known = set()
    for name, header, _, _, needed, aliases in ref.FILING_COLUMNS:
        candidates = [fold_header(h) for h in (header, *aliases)]
        known.update(candidates)
        hit = next((key for key in candidates if key in by_key), None)
        if hit is not None:
            source[name] = by_key[hit]
            if hit != candidates[0]:
                via_alias[name] = by_key[hit]
        elif needed:
            required.append(f"{name} ({header})")
        else:
            absent.append(name)
    if required:
        raise FilingSchemaError("required columns absent: " + "; ".join(required))
    extra = tuple(h for key, h in by_key.items() if key and key not in known)
    return HeaderMap(source, via_alias, tuple(absent), extra)


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def apply_headers(raw: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Rename one layout's text columns to the declared names; absent optional ones are null."""
    mapping = resolve_headers([c for c in raw.columns if c not in keep])
    return raw.select(
        *keep,
        *[
            (quoted(mapping.source[name]) if name in mapping.source else F.lit(None))
            .cast("string").alias(name)
            for name, *_ in ref.FILING_COLUMNS
        ],
    )


def header_report(layouts: dict[str, Sequence[str]]) -> list[tuple[str, str, str, str]]:
    """(layout, column, status, header) with status primary, alias, missing or unconsumed."""
    rows = []
    for layout, headers in layouts.items():
        mapping = resolve_headers(headers)
        for name, header in mapping.source.items():
            rows.append((layout, name, "alias" if name in mapping.via_alias else "primary", header))
        rows += [(layout, name, "missing", "") for name in mapping.missing_optional]
        rows += [(layout, "", "unconsumed", header) for header in mapping.unconsumed]
    return rows


def scan_period(spark: SparkSession, path: str, format: str = "csv") -> DataFrame:
    """One period's drop as text columns plus file name and in-file row order."""
    reader = spark.read.option("header", True) if format == "csv" else spark.read
    raw = reader.format(format).load(path)
    if raw.isEmpty():
        raise FilingSchemaError(f"{path}: no data rows")
    return raw.select(
        *[quoted(c).cast("string").alias(c) for c in raw.columns],
        F.col("_metadata.file_name").alias("source_file"),
        # split start first, then the row counter inside the split: the order in the file
        F.struct(
            F.col("_metadata.file_path"), F.col("_metadata.file_block_start"),
            F.monotonically_increasing_id(),
        ).alias("file_order"),
    )


def with_coverage(raw: DataFrame, coverage: str = "full", column: str = "report_coverage") -> DataFrame:
    """Keep full-year or partial-year filings; the two are never mixed."""
    if coverage not in ("full", "partial"):
        raise ValueError(f"coverage must be full or partial, not {coverage!r}")
    return raw.where(F.col(column) == coverage)


def latest_version(raw: DataFrame, period: str = "reporting_period", version: str = "file_version") -> DataFrame:
    """Rows of the highest version published for each period.

    The newest version per period is one row a period and goes to the rows, so no period is sent to one task.
    """
    newest = raw.groupBy(period).agg(F.max(version).alias(version))
    return raw.join(F.broadcast(newest), [period, version], "left_semi")


def typed_filings(text: DataFrame, keep: Iterable[str] = ("file_order", "source_file", "report_coverage")) -> DataFrame:
    """Declared text columns to typed columns, with the period backfilled from the file name."""
    kept = [c for c in keep if c in text.columns]
    columns = []
    for name, _, dimension, _, _, _ in ref.FILING_COLUMNS:
        if name not in text.columns:
            kind = {"imo": "bigint", "reporting_period": "int"}.get(
                name, "double" if dimension in ref.NUMERIC_DIMENSIONS else "string")
            column = F.lit(None).cast(kind)
        elif name == "imo":
            column = as_number(name).try_cast("bigint")
        elif name == "reporting_period":
            column = F.round(as_number(name)).try_cast("int")
            if "source_file" in kept:
                found = F.regexp_extract("source_file", PERIOD_PATTERN, 0)
                column = F.coalesce(column, found.try_cast("int"))
        elif dimension in ref.NUMERIC_DIMENSIONS:
            column = as_number(name)
        else:
            column = as_category(name)
        columns.append(column.alias(name))
    return text.select(*kept, *columns)


def cell_kind_counts(text: DataFrame, examples: int = 3) -> DataFrame:
    """Per file and column: number, null, error and unparseable cells, with a few unparseable texts.

    Counting is one wide aggregation by file, turned long afterwards, so cells are never exploded.
    Only unparseable cells become rows, and only distinct ones are shuffled and ranked.
    """
    names = [
        n for n, _, d, *_ in ref.FILING_COLUMNS if d in ref.NUMERIC_DIMENSIONS and n in text.columns
    ]
    kinds = ("number", "null", "error", "unparseable")
    tagged = text.select("source_file", *[cell_kind(n).alias(n) for n in names])
    wide = tagged.groupBy("source_file").agg(*[
        F.count_if(F.col(n) == k).alias(f"{n}:{k}") for n in names for k in kinds])
    counts = wide.select("source_file", F.explode(F.array(*[
        F.struct(F.lit(n).alias("column"), *[quoted(f"{n}:{k}").alias(f"{k}_cells") for k in kinds]) for n in names
    ])).alias("c")).select("source_file", "c.*")
    strange = F.explode(F.array_compact(F.array(*[
        F.when(cell_kind(n) == "unparseable", F.struct(F.lit(n).alias("column"), F.trim(n).alias("text"))) for n in names
    ])))
    odd = text.select("source_file", strange.alias("c")).select("source_file", "c.*").distinct()
    rank = F.row_number().over(Window.partitionBy("source_file", "column").orderBy("text"))
    shown = (
        odd.withColumn("_r", rank).where(F.col("_r") <= examples)
        .groupBy("source_file", "column")
        .agg(F.array_sort(F.collect_list("text")).alias("examples"))
    )
    return counts.join(shown, ["source_file", "column"], "left")


def is_filled() -> Column:
    """A filing that names its ship and its fuel."""
    return F.col("imo").isNotNull() & F.col("total_fuel_t").isNotNull()


def drop_blank(typed: DataFrame) -> DataFrame:
    return typed.where(is_filled())


def deduplicate(
    typed: DataFrame, keys: Sequence[str] = ("imo", "reporting_period"), order: str = "file_order"
) -> DataFrame:
    """One row per key: most populated fields first, then the last in file order.

    Rows are dealt out by key before they are sorted for the aggregate: sorting them in the tasks that read
    them spills whole splits of wide rows and leaves most of them. A key's rows pass as a stream, one held.
    """
    declared = [name for name, *_ in ref.FILING_COLUMNS if name in typed.columns]
    filled = reduce(
        lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in declared]
    )
    rest = [c for c in typed.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(filled, F.col(order)))
    return typed.repartition(*keys).groupBy(*keys).agg(best.alias("_row")).select(*keys, "_row.*")


def build_panel(text: DataFrame, coverage: str = "full") -> DataFrame:
    """Text filings to the ship-year panel."""
    return deduplicate(drop_blank(typed_filings(with_coverage(text, coverage))))


def union_periods(layouts: Sequence[DataFrame], keep: Sequence[str], periods: Sequence[int] | None = None) -> DataFrame:
    """Bring differently laid-out periods to the declared columns and stack them."""
    stacked = reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True),
        [apply_headers(raw, keep) for raw in layouts],
    )
    typed = typed_filings(stacked)
    if periods is not None:
        typed = typed.where(F.col("reporting_period").isin(list(periods)))
        if typed.isEmpty():
            raise ValueError(f"no reporting period matches {list(periods)}")
    return typed


MIN_DROP_BYTES = 1_000_000  # fixed value: smaller workbook drops are truncated
WORKBOOK_MAGIC = b"PK\x03\x04"  # fixed value
CHUNK_BYTES = 8 << 20


def _open(path: str):
    """A stream over a file, by whatever store its address names."""
    from pyarrow import fs

    address = re.sub(r"^file:/+", "file:///", path)
    store, inner = fs.FileSystem.from_uri(address)
    return store.open_input_stream(inner)


def input_manifest(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Bytes, SHA-256, magic check, version and period of every input file.

    Spark lists the files and deals them out; a task reads its files a chunk at a time, so their size does not matter.
    """
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", glob)
        .option("recursiveFileLookup", True).load(path).select("path", "length")
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, magic = [], []
            for name in batch.column("path").to_pylist():
                digest, first = hashlib.sha256(), b""
                with _open(name) as stream:
                    while chunk := stream.read(CHUNK_BYTES):
                        first = first or chunk[:4]
                        digest.update(chunk)
                digests.append(digest.hexdigest())
                magic.append(first)
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("length"), pa.array(digests, pa.string()), pa.array(magic, pa.binary())], ["path", "length", "sha256", "magic"])

    hashed = files.repartition("path").mapInArrow(read, "path string, length long, sha256 string, magic binary")
    name = F.element_at(F.split("path", "/"), -1)
    period = F.regexp_extract(name, PERIOD_PATTERN, 0)
    version = F.regexp_extract(name, r"_v(\d+)", 1)
    return hashed.select(
        name.alias("file_name"), F.col("length").alias("bytes"), "sha256",
        (F.col("magic") == F.lit(WORKBOOK_MAGIC)).alias("is_workbook"),
        (F.col("length") >= MIN_DROP_BYTES).alias("plausible_size"),
        F.when(period != "", period).cast("int").alias("reporting_period"),
        F.when(version != "", version).cast("int").alias("version"),
    )
