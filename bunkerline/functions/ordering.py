"""Global ranks, quantiles and neighbours without a single-task sort.

A window without PARTITION BY moves every row into one task. The helpers here deal the rows out
by ranges of the wanted order, whose bounds Spark samples from the data, and materialise them with
their range. Counts per range, offsets over the ranges (one row each) and windows within a range
then give positions in the whole order. Ties are dealt out by their tie column, so neither a narrow
band of values nor one value that many rows share meets in a task. The order is Spark's own: null
first, NaN last.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bunkerline.session import cut_lineage


def _ranged(df: DataFrame, order: Sequence[str], name: str = "_range") -> DataFrame:
    """The rows with the number of the range they are dealt to, fixed so that every later use sees the same one."""
    return cut_lineage(df.repartitionByRange(*order).withColumn(name, F.spark_partition_id()))


def global_rank(df: DataFrame, order: Sequence[str], name: str = "rank", groups: Sequence[str] = (), total: str | None = None) -> DataFrame:
    """1-based rank in the order of the columns, per ``groups`` if given.

    ``total`` names a column to receive the row count, so callers need no separate count job.
    """
    ranged = _ranged(df, [*groups, *order])
    sizes = ranged.groupBy(*groups, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *groups, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        *([F.sum("_n").over(Window.partitionBy(*groups)).alias(total)] if total else []),
    )
    on = [ranged[k].eqNullSafe(offsets[k]) for k in [*groups, "_range"]]
    extra = [offsets[c] for c in (["_offset", total] if total else ["_offset"])]
    joined = ranged.join(offsets, on, "left").select(ranged["*"], *extra)
    inside = Window.partitionBy(*groups, "_range").orderBy(*order)
    return joined.withColumn(name, (F.col("_offset") + F.row_number().over(inside)).cast("bigint")).drop("_offset", "_range")


def value_positions(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Distinct values per group with ``cnt`` copies and ``below`` = rows strictly smaller.

    Copies are combined before the shuffle, so a value held by a third of all rows is one row
    here; different values of a hot group spread over the ranges.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("cnt"))
    distinct = _ranged(counted, [*groups, value], "_bin")
    sizes = distinct.groupBy(*groups, "_bin").agg(F.sum("cnt").alias("_n"))
    across = Window.partitionBy(*groups).orderBy("_bin")
    sizes = sizes.select(
        *groups, "_bin",
        F.coalesce(
            F.sum("_n").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_offset"),
        F.sum("_n").over(Window.partitionBy(*groups)).alias("total"),
    )
    on = [distinct[k].eqNullSafe(sizes[k]) for k in [*groups, "_bin"]]
    joined = distinct.join(sizes, on).select(distinct["*"], sizes["_offset"], sizes["total"])
    inside = Window.partitionBy(*groups, "_bin").orderBy(value).rowsBetween(
        Window.unboundedPreceding, -1
    )
    return joined.select(
        *groups, value, "cnt", "total",
        (F.col("_offset") + F.coalesce(F.sum("cnt").over(inside), F.lit(0))).alias("below"),
    )


def exact_percentiles(
    df: DataFrame, groups: Sequence[str], value: str, probabilities: dict[str, float]
) -> DataFrame:
    """Exact linearly interpolated percentiles per group, one column per entry.

    The builtin ``percentile`` keeps every distinct value of a group in one buffer; this
    stays distributed for groups of any size. Also returns ``n`` = non-null rows.
    """
    placed = value_positions(df, groups, value)

    def at(position: Column) -> Column:
        hit = (F.col("below") <= position) & (position < F.col("below") + F.col("cnt"))
        return F.max(F.when(hit, F.col(value)))

    aggregates = [F.max("total").alias("n")]
    for name, p in probabilities.items():
        exact = F.lit(float(p)) * (F.col("total") - 1)
        aggregates += [
            at(F.floor(exact)).alias(f"_lo_{name}"),
            at(F.ceil(exact)).alias(f"_hi_{name}"),
            F.max(exact - F.floor(exact)).alias(f"_w_{name}"),
        ]
    found = placed.groupBy(*groups).agg(*aggregates)
    return found.select(
        *groups, "n",
        *[
            (
                F.col(f"_lo_{name}")
                + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * F.col(f"_w_{name}")
            ).alias(name)
            for name in probabilities
        ],
    )


def with_neighbours(df: DataFrame, value: str, tie: str, previous: str, following: str) -> DataFrame:
    """Add the previous and next ``value`` in the global (value, tie) order."""
    binned = _ranged(df, list(dict.fromkeys([value, tie])), "_bin")
    edges = binned.groupBy("_bin").agg(
        F.min(value).alias("_first"), F.max(value).alias("_last")
    )
    across = Window.orderBy("_bin")  # one row a range
    edges = edges.select(
        "_bin",
        F.lag("_last").over(across).alias("_prev_bin"),
        F.lead("_first").over(across).alias("_next_bin"),
    )
    inside = Window.partitionBy("_bin").orderBy(value, tie)
    return (
        binned.join(edges, "_bin")
        .withColumn(previous, F.coalesce(F.lag(value).over(inside), F.col("_prev_bin")))
        .withColumn(following, F.coalesce(F.lead(value).over(inside), F.col("_next_bin")))
        .drop("_bin", "_prev_bin", "_next_bin")
    )


def running_min_before(df: DataFrame, order: str, tie: str, value: str, name: str) -> DataFrame:
    """Add the minimum of ``value`` over all rows earlier in the global (order, tie) order."""
    binned = _ranged(df, list(dict.fromkeys([order, tie])), "_bin")
    lows = binned.groupBy("_bin").agg(F.min(value).alias("_low"))
    lows = lows.select(
        "_bin",
        F.min("_low").over(
            Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
        ).alias("_before"),
    )
    inside = Window.partitionBy("_bin").orderBy(order, tie).rowsBetween(
        Window.unboundedPreceding, -1
    )
    return (
        binned.join(lows, "_bin")
        .withColumn(name, F.least(F.min(value).over(inside), F.col("_before")))
        .drop("_bin", "_before")
    )
