"""Reading folders of filing drops whose headers drift, as one Spark data source.

``spark.read.format("filing_drops").load(folder)`` yields the declared columns as text, whatever layout each CSV or Parquet
file has. The driver lists the folder and reads headers only; a task gets a byte range of a CSV file or some row groups of a
Parquet file and resolves that file's headers itself. Filters on ``file_period`` drop whole files before any task starts.

Defined results: an optional column that a layout lacks is null, a file that lacks a required one raises
``FilingSchemaError``, a file without data rows raises too unless ``allowEmpty`` is true (then it adds no rows). Files of other
endings are left out. A CSV row with another number of cells than its header raises; an empty cell is null.
CSV cells may be quoted but not hold line breaks, so that a file can be cut anywhere; Spark's own reader cuts alike.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from bunkerline import reference as ref
from bunkerline.sources.filings import PERIOD_PATTERN, FilingSchemaError, resolve_headers

SPLIT_BYTES = 64 << 20
BLOCK_BYTES = 4 << 20
DECLARED = tuple(name for name, *_ in ref.FILING_COLUMNS)


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path inside it, by whatever store the address names."""
    address = re.sub(r"^file:/+", "file:///", path)
    return fs.FileSystem.from_uri(address if ":/" in address else f"file://{address}")


@dataclass
class DropPart(InputPartition):
    """A byte range of a file; of a Parquet file, the row groups whose middle is in it."""

    path: str
    start: int
    end: int
    size: int = 0

    def __post_init__(self):
        super().__init__(None)


def file_period(path: str) -> int | None:
    """The first year that a path names, as seen from the folder of drops."""
    found = re.search(PERIOD_PATTERN, path)
    return int(found.group()) if found else None


def csv_header(stream) -> tuple[list[str], int]:
    """Header cells and the offset of the first data byte."""
    line = bytearray()
    while not line.endswith(b"\n"):
        piece = stream.read(1 << 12)
        if not piece:
            break
        at = piece.find(b"\n")
        line += piece if at < 0 else piece[: at + 1]
    text = bytes(line).decode("utf-8-sig")
    return next(csv.reader([text]), []), len(line)


def lines_of(stream, first: int, start: int, end: int) -> Iterator[bytes]:
    """Blocks of whole lines that begin in [start, end); ``first`` is where data begin."""
    at = max(start, first)
    if at > first:
        # a line belongs to the range its first byte is in: look one byte back for its end
        at -= 1
        stream.seek(at)
        while True:
            piece = stream.read(1 << 16)
            if not piece:
                return
            cut = piece.find(b"\n")
            if cut >= 0:
                at += cut + 1
                break
            at += len(piece)
    stream.seek(at)
    rest = b""
    while at < end:
        piece = stream.read(BLOCK_BYTES)
        block = rest + piece
        cut = block.rfind(b"\n") + 1 if piece else len(block)
        whole, rest = block[:cut], block[cut:]
        if whole and at + len(whole) > end:
            last = whole.find(b"\n", max(end - at - 1, 0))  # the line that holds the byte before the end is the last
            whole = whole if last < 0 else whole[: last + 1]
            yield whole
            return
        if whole:
            yield whole
        at += len(whole)
        if not piece:
            return


class DropReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        self.keep = [c for c in options.get("keep", "").split(",") if c]
        self.allow_empty = str(options.get("allowempty", "false")).lower() == "true"
        self.periods: list = []

    def pushFilters(self, filters):
        for f in filters:
            known = isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual))
            if known and f.attribute == ("file_period",):
                self.periods.append(f)
            else:
                yield f

    def _wanted(self, period: int | None) -> bool:
        def holds(f) -> bool:
            if period is None or getattr(f, "value", None) is None:
                return False  # a comparison with null is not true
            if isinstance(f, In):
                return period in f.value
            if isinstance(f, EqualTo):
                return period == f.value
            if isinstance(f, GreaterThan):
                return period > f.value
            if isinstance(f, GreaterThanOrEqual):
                return period >= f.value
            return period < f.value if isinstance(f, LessThan) else period <= f.value

        return all(holds(f) for f in self.periods)

    def files(self) -> list[tuple[str, int]]:
        store, root = open_store(self.path)
        info = store.get_file_info(root)
        found = [info] if info.is_file else store.get_file_info(fs.FileSelector(root, recursive=True))
        return sorted(
            (f.path, f.size) for f in found
            if f.is_file and f.path.endswith((".csv", ".parquet"))
            and not any(p.startswith(("_", ".")) for p in f.path[len(root):].split("/"))
            and self._wanted(file_period(f.path[len(root):] or f.base_name)))

    def partitions(self) -> list[DropPart]:
        parts = []
        for path, size in self.files():
            parts += [DropPart(path, at, min(at + self.split, size), size) for at in range(0, max(size, 1), self.split)]
        return parts or [DropPart("", 0, 0)]

    def _shape(self, table: pa.Table, headers: list[str], path: str, period: int | None, row: int, start: int) -> pa.RecordBatch:
        mapping = resolve_headers([h for h in headers if h not in self.keep])
        n = table.num_rows

        def text(name: str | None) -> pa.Array:
            if name is None:
                return pa.nulls(n, pa.string())
            return table.column(name).cast(pa.string()).combine_chunks()

        columns = [text(c if c in headers else None) for c in self.keep]
        columns += [text(mapping.source.get(name)) for name in DECLARED]
        columns += [pa.array([path] * n, pa.string()), pa.array([period] * n, pa.int32()),
                    pa.array([start] * n, pa.int64()), pa.array(range(row, row + n), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, [*self.keep, *DECLARED, "source_path", "file_period", "split_start", "split_row"])

    def read(self, partition: DropPart) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store, root = open_store(self.path)
        period = file_period(partition.path[len(root):] or partition.path.rsplit("/", 1)[-1])
        tables = self._csv(store, partition) if partition.path.endswith(".csv") else self._parquet(store, partition)
        row = 0
        for headers, table in tables:
            yield self._shape(table, headers, partition.path, period, row, partition.start)
            row += table.num_rows
        if row == 0 and partition.start == 0 and not self.allow_empty and self._is_empty(store, partition):
            raise FilingSchemaError(f"{partition.path}: no data rows")

    def _is_empty(self, store, partition: DropPart) -> bool:
        if not partition.path.endswith(".csv"):
            return pq.ParquetFile(partition.path, filesystem=store).metadata.num_rows == 0
        with store.open_input_file(partition.path) as stream:
            _, first = csv_header(stream)
            return stream.size() <= first

    def _csv(self, store, partition: DropPart):
        from pyarrow import csv as arrow_csv

        with store.open_input_file(partition.path) as stream:
            headers, first = csv_header(stream)
            if not headers:
                return
            names = [f"{at}" for at in range(len(headers))]  # headers may repeat: places are unique
            kept = [at for at, h in enumerate(headers) if h not in headers[:at]]
            resolve_headers([h for h in headers if h not in self.keep])  # also where no row follows
            if partition.end <= first:
                return
            for block in lines_of(stream, first, partition.start, partition.end):
                if not block.strip():
                    continue
                table = arrow_csv.read_csv(
                    io.BytesIO(block), read_options=arrow_csv.ReadOptions(column_names=names, block_size=len(block) + 1, use_threads=False),
                    convert_options=arrow_csv.ConvertOptions(
                        column_types={n: pa.string() for n in names}, null_values=[""], strings_can_be_null=True, quoted_strings_can_be_null=True))
                table = table.select([names[at] for at in kept]).rename_columns([headers[at] for at in kept])
                yield [headers[at] for at in kept], table

    def _parquet(self, store, partition: DropPart):
        file = pq.ParquetFile(partition.path, filesystem=store)
        headers = list(file.schema_arrow.names)
        mapping = resolve_headers([h for h in headers if h not in self.keep])
        wanted = sorted({*mapping.source.values(), *(c for c in self.keep if c in headers)})
        groups = []
        for at in range(file.metadata.num_row_groups):
            group = file.metadata.row_group(at)
            first = group.column(0)
            offset = min(o for o in (first.dictionary_page_offset, first.data_page_offset) if o)
            size = sum(group.column(c).total_compressed_size for c in range(group.num_columns))
            if partition.start <= min(offset + size // 2, partition.size - 1) < partition.end:
                groups.append(at)
        for batch in file.iter_batches(columns=wanted, row_groups=groups, batch_size=1 << 14) if groups else ():
            yield headers, pa.Table.from_batches([batch])


class FilingDrops(DataSource):
    @classmethod
    def name(cls) -> str:
        return "filing_drops"

    def schema(self) -> str:
        keep = [c for c in self.options.get("keep", "").split(",") if c]
        texts = ", ".join(f"`{c}` string" for c in (*keep, *DECLARED))
        return f"{texts}, source_path string, file_period int, split_start bigint, split_row bigint"

    def reader(self, schema: StructType) -> DropReader:
        return DropReader(dict(self.options))


def read_drops(spark: SparkSession, path: str, keep: tuple[str, ...] = (), allow_empty: bool = False, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """All drops under ``path``: declared columns as text, file, period, version named by the file (else 0) and ``drop_order`` (path, range, row).

    ``keep`` names published columns that pass through under their own names.
    """
    spark.dataSource.register(FilingDrops)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    raw = (
        spark.read.format("filing_drops").option("keep", ",".join(keep)).option("allowEmpty", str(allow_empty).lower())
        .option("splitBytes", str(split_bytes)).load(path)
    )
    order = F.struct("source_path", "split_start", "split_row").alias("drop_order")
    version = F.coalesce(F.regexp_extract("source_path", r"_v(\d+)[^/]*$", 1).try_cast("int"), F.lit(0)).alias("file_version")
    return raw.select(*keep, *DECLARED, "source_path", "file_period", version, order)


def layout_report(spark: SparkSession, path: str) -> DataFrame:
    """Per file: its period and which columns came by their first header, by an alias, are absent or not consumed."""
    reader = DropReader({"path": path})

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(path)
        for batch in batches:
            rows = []
            for name in batch.column("source_path").to_pylist():
                if name.endswith(".csv"):
                    with store.open_input_file(name) as stream:
                        headers, _ = csv_header(stream)
                else:
                    headers = list(pq.ParquetFile(name, filesystem=store).schema_arrow.names)
                found = resolve_headers(headers)
                period = file_period(name[len(root):])
                rows += [(name, period, c, "alias" if c in found.via_alias else "primary", h) for c, h in found.source.items()]
                rows += [(name, period, c, "missing", None) for c in found.missing_optional]
                rows += [(name, period, None, "unconsumed", h) for h in found.unconsumed]
            names = ["source_path", "file_period", "column", "status", "header"]
            kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    paths = [(p,) for p, _ in reader.files()]
    listed = spark.createDataFrame(paths, "source_path string").repartition("source_path")
    return listed.mapInArrow(report, "source_path string, file_period int, column string, status string, header string")
