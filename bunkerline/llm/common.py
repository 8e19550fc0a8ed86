"""Small helpers the operators share."""

from __future__ import annotations

import contextlib
import ctypes
import random
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from bunkerline.session import cut_lineage, shared_dir

MASK = (1 << 64) - 1


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def store(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder; what follows never replays the work before it."""
    return cut_lineage(df)


def stash(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """The same as a compressed Parquet table, for rows that several branches of a plan read."""
    path = f"{shared_dir(df.sparkSession)}/stash-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release() -> None:
    """Give freed memory back to the system at the end of a task: its worker lives on, and tasks of later stages run in it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only some C libraries have it
        ctypes.CDLL(None).malloc_trim(0)


def tag() -> str:
    """A suffix that keeps working columns apart from whatever columns a caller's table has."""
    return f"{random.getrandbits(32):08x}"


def signed(value: int) -> int:
    """An unsigned 64-bit number as Spark's long."""
    value &= MASK
    return value - (1 << 64) if value >> 63 else value


def blobs(column: pa.Array | pa.ChunkedArray) -> Iterator[bytes]:
    """The values of a string or binary column as bytes, null as empty."""
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""


def slices(batch: pa.RecordBatch, column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that no part holds much more than `limit` bytes of one text column; a longer row is alone."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from its concatenated values."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
