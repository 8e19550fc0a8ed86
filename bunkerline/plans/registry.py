"""Query registry: each entry is a Spark plan over the given tables plus, where SQL can say
it, the statement an independent engine must agree with."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bunkerline import dims
from bunkerline.operators import derive
from bunkerline.session import shared_dir, tune
from bunkerline.sources import filings as filing_source
from bunkerline.sources import sinks
from bunkerline.sources.views import BASE_TABLES, VIEWS, portable_sql, read_view

QUERIES: dict[str, Callable[["Inputs"], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, str] = {}
_STORED: dict[tuple, str] = {}


class Inputs:
    """The given tables of one folder and the views over them, opened on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._views: dict[str, DataFrame] = {}
        tune(spark)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        if name not in self._views:
            needed = {t: self.table(t) for t in BASE_TABLES if "{" + t + "}" in VIEWS[name]}
            self._views[name] = read_view(self.spark, name, needed)
        return self._views[name]

    def dim(self, name: str) -> DataFrame:
        return dims.TABLES[name](self.spark)

    def identity(self, name: str) -> tuple:
        """Number of a table's files and a sum over their names, sizes and times, which a rewrite in place changes."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{self.folder}/{name}.parquet")
        mark = F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")
        return tuple(files.select(mark.alias("m")).agg(F.count("*"), F.sum("m")).first())

    @cached_property
    def filings(self) -> DataFrame:
        return self.view("v_filings")

    @cached_property
    def typed(self) -> DataFrame:
        return filing_source.typed_filings(filing_source.with_coverage(self.filings))

    @cached_property
    def panel(self) -> DataFrame:
        return filing_source.build_panel(self.filings)

    @cached_property
    def derived(self) -> DataFrame:
        return derive.derive_physics(self.panel)

    @cached_property
    def stored(self) -> DataFrame:
        """The derived panel as a Parquet table in the shared folder, written once per session.

        Everything after the panel reads it several times (levels, residuals, bands, folds), so
        it is handed over as a table, pruned to the columns and periods a query needs, instead of
        being rebuilt from text inside every branch of a plan.
        """
        key = self.source_key
        if key not in _STORED:
            _STORED[key] = sinks.write_panel(self.derived)
        return self.spark.read.parquet(_STORED[key])

    @cached_property
    def source_key(self) -> tuple:
        """The session and the files that the panel comes from."""
        return (self.spark.sparkContext.applicationId, self.folder, *(self.identity(n) for n in ("lineitem", "part")))

    def folder_of(self, name: str, write: Callable[[str], None]) -> str:
        """A folder of the shared one that ``write`` fills, once for a session and set of input files."""
        key = (name, *self.source_key)
        if key not in _STORED:
            path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
            write(path)
            _STORED[key] = path
        return _STORED[key]

    def kept(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A table worked out from the panel, written once like it."""
        return self.spark.read.parquet(self.folder_of(name, lambda path: build().write.parquet(path)))

    @cached_property
    def usable(self) -> DataFrame:
        return self.stored.where("is_usable")


def query(name: str, oracle: str | None = None):
    def register(build: Callable[[Inputs], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = build
        if oracle is not None:
            ORACLES[name] = oracle
        return build

    return register


def cte(name: str, body: str) -> None:
    CTES[name] = body


_NAME = re.compile(r"\b[ov]_[a-z0-9_]+\b")


def full_sql(statement: str) -> str:
    """Prefix a statement with the common tables it names, dependencies first."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in dict.fromkeys(_NAME.findall(text)):
            if name in order:
                continue
            if name in CTES:
                visit(CTES[name])
            elif name not in VIEWS:
                continue
            order.append(name)

    visit(statement)
    parts = [f"{n} AS ({CTES[n] if n in CTES else portable_sql(n)})" for n in order]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + statement


def values_cte(name: str, columns: str, rows) -> None:
    """A constant table as VALUES text."""
    spec = [p.strip().split(" ") for p in columns.split(",")]
    kinds = {"string": "VARCHAR", "double": "DOUBLE", "int": "INTEGER", "boolean": "BOOLEAN"}

    def cell(v, kind):
        if v is None:
            return f"CAST(NULL AS {kinds[kind]})"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return f"CAST({v!r} AS {kinds[kind]})"

    body = ", ".join("(" + ", ".join(cell(v, k) for v, (_, k) in zip(r, spec)) + ")" for r in rows)
    cte(name, f"SELECT * FROM (VALUES {body}) t({', '.join(n for n, _ in spec)})")
