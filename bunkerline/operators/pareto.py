"""Pareto fronts and their quality, all objectives minimised.

Fronts of any input size are found in two streaming phases and never by comparing every pair:
equal vectors collapse first, each partition keeps only its own front, and the survivors are
compared cell by cell on an equi-depth grid that grows with their number.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bunkerline.functions.ordering import (
    global_rank, running_min_before, value_positions, with_neighbours,
)
from bunkerline.session import cut_lineage

FEASIBLE = 1e-9
CELL_ROWS = 2048
TILE_ROWS = 2048
CELL_POINTS = 512
GUARDS = 64


def dominates(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """No worse everywhere, better somewhere."""
    no_worse = reduce(lambda x, y: x & y, [p <= q for p, q in zip(a, b, strict=True)])
    return no_worse & reduce(lambda x, y: x | y, [p < q for p, q in zip(a, b, strict=True)])


def feasible(df: DataFrame, violation: str | None) -> DataFrame:
    return df if violation is None else df.where(F.col(violation) <= FEASIBLE)


def _front_stream(objectives: list[str], key: str):
    """Emit own rows no earlier row of the same key dominates, once per vector.

    Rows of a key arrive in (sum, objectives...) order, in which a dominating row always comes
    first and equal vectors are neighbours, so the state is the front found so far. Many rows at a time
    first meet a few strong points of it, and what is left the whole of it.
    """
    def keep(window: list[np.ndarray], points: np.ndarray) -> np.ndarray:
        alive = np.ones(len(points), dtype=bool)
        for block in window:
            for start in range(0, len(block), 1024):
                part = block[start:start + 1024]
                rest = points[alive]
                if not len(rest):
                    return alive
                no_worse = (part[None, :, :] <= rest[:, None, :]).all(axis=2)
                better = (part[None, :, :] < rest[:, None, :]).any(axis=2)
                alive[np.flatnonzero(alive)[(no_worse & better).any(axis=1)]] = False
        return alive

    def strong(front: np.ndarray) -> np.ndarray:
        """A few points of the front: those with the most room above them, and some along the first objective."""
        if len(front) <= GUARDS:
            return front
        with np.errstate(invalid="ignore", over="ignore"):
            room = np.nan_to_num(np.prod((front.max(axis=0) - front) / np.maximum(np.ptp(front, axis=0), 1e-300), axis=1))
        along = np.argsort(front[:, 0])[:: -(-2 * len(front) // GUARDS)]
        return front[np.union1d(np.argsort(-room)[: GUARDS // 2], along)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, window, last, guards, size = None, [], None, None, 0
        for batch in batches:
            for value, rows in batch.groupby(key, sort=False):
                if value != current:
                    current, window, last, guards, size = value, [], None, None, 0
                vectors = rows[objectives].to_numpy(dtype="float64")
                fresh = np.ones(len(vectors), dtype=bool)
                fresh[1:] = (vectors[1:] != vectors[:-1]).any(axis=1)
                fresh[0] = last is None or bool((vectors[0] != last).any())
                last, rows = vectors[-1], rows[fresh]
                for begin in range(0, len(rows), 4096):
                    some = rows.iloc[begin:begin + 4096]
                    found = sum(map(len, window))
                    if found > 1.25 * size:
                        guards, size = strong(np.concatenate(window)), found
                    if guards is not None:
                        some = some[keep([guards], some[objectives].to_numpy(dtype="float64"))]
                    for start in range(0, len(some), 256):
                        chunk = some.iloc[start:start + 256]
                        points = chunk[objectives].to_numpy(dtype="float64")
                        alive = keep(window, points)
                        alive[alive] = keep([points[alive]], points[alive])
                        if alive.any():
                            window.append(points[alive])
                            yield chunk[alive & chunk["_own"].to_numpy(dtype=bool)]
                    if len(window) > 8:
                        window = [np.concatenate(window)]

    return run


def _stream_fronts(df: DataFrame, objectives: list[str], key: str) -> DataFrame:
    total = reduce(lambda a, b: a + b, [F.col(c) for c in objectives])
    ordered = df.withColumn("_sum", total).sortWithinPartitions(key, "_sum", *objectives)
    return ordered.mapInPandas(_front_stream(objectives, key), ordered.schema).drop("_sum")


def _drop_beaten(vectors: DataFrame, objectives: list[str], grouped: bool) -> DataFrame:
    """Drop rows beaten by a few strong rows, before anything is sorted or leaves the JVM.

    The strong rows are one aggregate: the best in each objective and the best geometric mean.
    They are real rows of the data, so whatever they dominate cannot be on the front. One row a group goes to the rows: a shuffle
    would bring each group's rows to one task, and the fronts of partitions would be fronts of groups.
    """
    vector = F.struct(*objectives)
    mean = reduce(lambda a, b: a + b, [F.ln(F.greatest(F.col(c), F.lit(1e-300))) for c in objectives])
    best = [F.min_by(vector, by).alias(f"_p{i}") for i, by in enumerate([mean, *[F.struct(c, *objectives) for c in objectives]])]
    pivots = vectors.groupBy("_key").agg(*best) if grouped else vectors.agg(*best).withColumn("_key", F.lit(""))
    rows = vectors.join(F.broadcast(pivots), "_key")
    for i in range(len(best)):
        rows = rows.where(~dominates([F.col(f"_p{i}.{c}") for c in objectives], [F.col(c) for c in objectives]))
    return rows.select(*vectors.columns)


def front_vectors(df: DataFrame, objectives: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Distinct non-dominated vectors, per group of ``by`` (few groups).

    Input rows are not shuffled: each partition is reduced to its own front where it lies.
    """
    objectives = list(objectives)
    group = F.concat_ws("|", *[F.col(c).cast("string") for c in by]) if by else F.lit("")
    vectors = df.select(*by, *[F.col(c).cast("double").alias(c) for c in objectives]).withColumns(
        {"_key": group, "_own": F.lit(True)})
    local = _stream_fronts(_drop_beaten(vectors, objectives, bool(by)), objectives, "_key")
    survivors = cut_lineage(local.dropDuplicates())
    return _grid_front(survivors, objectives).drop("_key", "_own")


def _grid_front(survivors: DataFrame, objectives: list[str]) -> DataFrame:
    """Compare survivors cell by cell, on one path whatever their number; no cell or point passes the driver.

    A front of d objectives has d - 1 free ones, so a grid of (rows / CELL_ROWS) ** (1 / (d - 1)) bins a side has about
    rows / CELL_ROWS occupied cells. A cell that lies above another one in every bin is dominated whole and goes. Any other
    cell shares a bin with each cell that reaches it, so the pairs of cells to compare come from d equi-joins, and a point
    travels only to cells whose highest corner it does not exceed.
    """
    d = len(objectives)
    bins_of = [f"_b{i}" for i in range(d)]
    largest = survivors.groupBy("_key").count().agg(F.max("count")).first()[0] or 1
    bins = math.ceil((largest / CELL_ROWS) ** (1.0 / max(1, d - 1)))
    share = [i / bins for i in range(1, bins)]
    cuts = survivors.agg(*[F.percentile_approx(c, share, 10000).alias(c) for c in objectives]).first() if share else None

    def bin_of(c: str) -> Column:
        return F.size(F.filter(F.lit([float(v) for v in cuts[c]]), lambda e: e <= F.col(c))) if cuts else F.lit(0)

    placed = survivors.withColumns({b: bin_of(c) for b, c in zip(bins_of, objectives)})
    corners = [f(c).alias(f"_{n}_{c}") for c in objectives for n, f in (("lo", F.min), ("hi", F.max))]
    cells = cut_lineage(_unbeaten_cells(placed.groupBy("_key", *bins_of).agg(*corners), bins_of, bins))

    to = [f"_t{i}" for i in range(d)]
    above = cells.select("_key", *[F.col(b).alias(t) for b, t in zip(bins_of, to)], *[F.col(f"_hi_{c}").alias(f"_top_{c}") for c in objectives])
    below = cells.select("_key", *bins_of, *[f"_lo_{c}" for c in objectives])
    reaches = reduce(lambda a, b: a & b, [F.col(b) <= F.col(t) for b, t in zip(bins_of, to)] + [F.col(f"_lo_{c}") <= F.col(f"_top_{c}") for c in objectives])
    pairs = []
    for i, (b, t) in enumerate(zip(bins_of, to)):  # the first bin that both share names the pair, so each comes once
        first = reduce(lambda x, y: x & y, [F.col(bins_of[j]) < F.col(to[j]) for j in range(i)], F.lit(True))
        met = below.join(above.withColumnRenamed("_key", "_k"), (F.col("_key") == F.col("_k")) & (F.col(b) == F.col(t)))
        pairs.append(met.where(reaches & first).select("_key", *bins_of, *to, *[f"_top_{c}" for c in objectives]))
    own = reduce(lambda a, b: a & b, [F.col(b) == F.col(t) for b, t in zip(bins_of, to)])
    within = reduce(lambda a, b: a & b, [F.col(c) <= F.col(f"_top_{c}") for c in objectives])
    sent = placed.join(reduce(DataFrame.unionByName, pairs), ["_key", *bins_of]).where(within).select(
        *survivors.drop("_own").columns, own.alias("_own"), F.concat_ws("#", "_key", *to).alias("_target"))
    return _stream_fronts(sent.repartition("_target"), objectives, "_target").drop("_target")


def _unbeaten_cells(cells: DataFrame, bins_of: list[str], bins: int) -> DataFrame:
    """Cells with no occupied cell below them in every bin.

    A table over all but the last bin (rows / CELL_ROWS entries a group) holds the lowest last bin of any cell up to each
    place: running minima along one side after the other, each over windows of one side's length.
    """
    *sides, last = bins_of
    table = cells.select("_key").distinct()
    for b in sides:
        table = table.withColumn(b, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    table = table.join(cells.groupBy("_key", *sides).agg(F.min(last).alias("_low")), ["_key", *sides], "left")
    for b in sides:
        others = [c for c in sides if c != b]
        table = table.withColumn("_low", F.min("_low").over(
            Window.partitionBy("_key", *others).orderBy(b).rowsBetween(Window.unboundedPreceding, 0)))
    lower = table.select("_key", *[(F.col(b) + 1).alias(b) for b in sides], "_low")
    rows = cells.join(lower, ["_key", *sides], "left")
    return rows.where(F.col("_low").isNull() | (F.col("_low") >= F.col(last))).drop("_low")


def skyline(
    df: DataFrame, objectives: Sequence[str], violation: str | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Feasible non-dominated rows; rows with equal objectives are all kept."""
    rows = feasible(df, violation)
    front = front_vectors(rows, objectives, by)
    return rows.join(front, [*by, *objectives], "left_semi")


def constrained_rank(df: DataFrame, objectives: Sequence[str], violation: str, key: str) -> DataFrame:
    """Add ``tier`` (0 feasible front, 1 other feasible, 2 infeasible) and, for infeasible rows,
    ``violation_rank``: one plus the rows with a smaller violation."""
    front = skyline(df, objectives, violation).select(F.col(key).alias("_f"))
    infeasible = df.where(F.col(violation) > FEASIBLE)
    placed = value_positions(infeasible, [], violation).select(
        F.col(violation).alias("_v"), (F.col("below") + 1).alias("violation_rank"))
    out = df.join(front, F.col(key) == F.col("_f"), "left").join(
        placed, (F.col(violation) == F.col("_v")) & (F.col(violation) > FEASIBLE), "left")
    tier = F.when(F.col(violation) > FEASIBLE, 2).when(F.col("_f").isNotNull(), 0).otherwise(1)
    return out.withColumn("tier", tier).drop("_f", "_v")


def reference_point(fronts: DataFrame, objectives: Sequence[str], margin: float = 0.1) -> DataFrame:
    """One row: worst plus a margin of the span over the union of fronts."""
    edges = fronts.agg(*[f(c).alias(f"_{n}_{c}") for c in objectives for n, f in (("lo", F.min), ("hi", F.max))])

    def point(c: str) -> Column:
        lo, hi = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        return hi + margin * F.when(hi > lo, hi - lo).otherwise(F.abs(hi) + 1.0)

    return edges.select(*[point(c).alias(f"ref_{c}") for c in objectives])


def hypervolume_2d(front: DataFrame, x: str, y: str, reference: tuple[float, float]) -> DataFrame:
    """Area dominated up to the reference: a sweep by x with the best y so far."""
    rx, ry = reference
    inside = front.where((F.col(x) < rx) & (F.col(y) < ry)).groupBy(x).agg(F.min(y).alias(y))
    swept = running_min_before(inside, x, y, y, "_best")
    best = F.least(F.coalesce("_best", F.lit(float(ry))), F.lit(float(ry)))
    area = F.when(F.col(y) < best, (rx - F.col(x)) * (best - F.col(y))).otherwise(0.0)
    return swept.agg(F.coalesce(F.sum(area), F.lit(0.0)).alias("hypervolume"))


class Staircase:
    """The area that points (x, y) dominate up to a reference, kept while points are added.

    Steps are in order of x, with y falling; a new point cuts out the steps that it dominates, so each point comes and goes once.
    """

    def __init__(self, rx: float, ry: float):
        self.rx, self.ry, self.area = rx, ry, 0.0
        self.x: list[float] = []
        self.y: list[float] = []

    def add(self, x: float, y: float) -> None:
        at = bisect.bisect_right(self.x, x)
        if not (x < self.rx and y < self.ry) or at and self.y[at - 1] <= y:
            return
        first = at - 1 if at and self.x[at - 1] == x else at
        last, roof = first, self.y[first - 1] if first else self.ry
        left = x
        while last < len(self.x) and self.y[last] >= y:  # what lies over the steps that go
            self.area += (self.x[last] - left) * (roof - y)
            left, roof = self.x[last], self.y[last]
            last += 1
        self.area += ((self.x[last] if last < len(self.x) else self.rx) - left) * (roof - y)
        self.x[first:last], self.y[first:last] = [x], [y]


def hypervolume_3d(front: DataFrame, objectives: Sequence[str], reference: Sequence[float], range_rows: int = 1 << 15) -> DataFrame:
    """Exact volume by a sweep over z, in ranges of z that Spark samples.

    A range is entered with the staircase of all earlier ranges, so it needs their (x, y) fronts and none of their other points; inside it the area
    grows point by point, and each level counts with its distance to the next one. Rows are the front and the ranges' staircases.
    """
    x, y, z = objectives
    rx, ry, rz = (float(v) for v in reference)
    beats = reduce(lambda a, b: a & b, [F.col(c) < float(r) for c, r in zip(objectives, reference)])
    points = cut_lineage(front_vectors(front.where(beats), objectives).select(F.col(x).alias("x"), F.col(y).alias("y"), F.col(z).alias("z")))
    ranges = max(1, math.ceil(points.count() / range_rows))
    ranged = cut_lineage(points.repartitionByRange(ranges, "z").withColumn("_range", F.spark_partition_id()))
    starts = {r["_range"]: r["z"] for r in ranged.groupBy("_range").agg(F.min("z").alias("z")).collect()}  # one row a range
    order = sorted(starts)
    following = {r: starts[n] for r, n in zip(order, order[1:])}
    lowest = F.min("y").over(Window.partitionBy("_range").orderBy("x", "y").rowsBetween(Window.unboundedPreceding, -1))
    steps = ranged.select("_range", "x", "y").withColumn("_low", lowest).where("_low is null or y < _low").drop("_low")
    later = F.filter(F.array(*[F.lit(r) for r in order]), lambda r: r > F.col("_range"))
    entered = steps.select(F.explode(later).alias("_range"), "x", "y", F.lit(None).cast("double").alias("z"))

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, stairs, level, volume, out = None, None, None, 0.0, []
        for batch in batches:
            for own, px, py, pz in zip(*(batch[c].tolist() for c in ("_range", "x", "y", "z"))):
                if own != current:
                    if current is not None:
                        out.append(volume + (stairs.area * (following.get(current, rz) - level) if level is not None else 0.0))
                    current, stairs, level, volume = own, Staircase(rx, ry), None, 0.0
                if pz == pz:  # a point; the steps that the range is entered with come first
                    if level is not None and pz > level:
                        volume += stairs.area * (pz - level)
                    level = pz
                stairs.add(px, py)
        if current is not None:
            out.append(volume + (stairs.area * (following.get(current, rz) - level) if level is not None else 0.0))
        yield pd.DataFrame({"volume": out}, dtype="float64")

    rows = ranged.select("_range", "x", "y", "z").unionByName(entered)
    parts = rows.repartition(ranges, "_range").sortWithinPartitions("_range", F.col("z").asc_nulls_first(), "x", "y").mapInPandas(sweep, "volume double")
    return parts.agg(F.coalesce(F.sum("volume"), F.lit(0.0)).alias("hypervolume"))


def _nested_cuts(points: DataFrame, objectives: Sequence[str], bins: int) -> list[np.ndarray]:
    """Cut points of nested equi-depth boxes, boxes so far x cuts: of the first objective over all points, of each next one within each box so far."""
    share, tables = [i / bins for i in range(1, bins)], []
    for i, c in enumerate(objectives):
        table = np.full((bins**i, bins - 1), np.inf)
        if share:
            placed = _in_boxes(points.select(*objectives), objectives[:i], tables, bins)
            for box, cuts in placed.groupBy("_box").agg(F.percentile_approx(c, share, 10000)).collect():  # a row for bins * CELL_POINTS points or more
                table[box] = cuts
        tables.append(table)
    return tables


def _in_boxes(rows: DataFrame, objectives: Sequence[str], tables: Sequence[np.ndarray], bins: int, reach: Column | None = None) -> DataFrame:
    """A row for the box of each row, or with a reach for each box that may hold a point so near."""
    schema = rows.withColumn("_box", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for begin in range(0, len(batch), 4096):
                some = batch.iloc[begin:begin + 4096]
                at, box = np.arange(len(some)), np.zeros(len(some), np.int64)
                for c, cuts in zip(objectives, tables):
                    value, off = some[c].to_numpy(dtype="float64")[at], some["_reach"].to_numpy(dtype="float64")[at]
                    low, high = ((cuts[box] <= edge[:, None]).sum(axis=1) for edge in (value - off, value + off))
                    wide = np.maximum(high - low, 0) + 1
                    at, box, low = np.repeat(at, wide), np.repeat(box, wide), np.repeat(low, wide)
                    box = box * bins + low + np.arange(len(at)) - np.repeat(np.cumsum(wide) - wide, wide)
                yield some.iloc[at].drop(columns="_reach").assign(_box=box)

    return rows.withColumn("_reach", F.lit(0.0) if reach is None else reach).mapInPandas(run, schema)


def nearest_distance(
    targets: DataFrame, found: DataFrame, key: str, objectives: Sequence[str], skip_self: bool = False, by: Sequence[str] = ()
) -> DataFrame:
    """Distance from each target to its nearest found point, exactly, among those of the same ``by`` if given.

    Equal vectors are handled once. Found points lie in nested equi-depth boxes, which follow them where objectives depend on each other. A target
    first meets the points of its own box, which bounds its distance, then those of the boxes that it can still reach; most reach no other.
    A target without points in its box is bounded by a few points of its group. Groups share the boxes and the jobs.
    """
    objectives, by = list(objectives), list(by)
    vectors, group = [F.col(c).cast("double").alias(c) for c in objectives], F.to_json(F.struct(*by)) if by else F.lit("")
    points = cut_lineage(found.select(*by, *vectors).groupBy(*by, *objectives).agg(F.count(F.lit(1)).alias("_copies")))
    there = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in by] + [F.abs(c) < float("inf") for c in objectives])
    finite = points.where(there).select(group.alias("_key"), *objectives)
    asked = targets.select(group.alias("_key"), *vectors).dropna(subset=objectives).dropDuplicates()
    bins = max(1, int((points.count() / CELL_POINTS) ** (1.0 / len(objectives))))
    cuts = _nested_cuts(finite, objectives, bins)
    placed = cut_lineage(_in_boxes(finite, objectives, cuts, bins))
    # a box that ties make dense is dealt out over several tasks
    boxes = cut_lineage(placed.groupBy("_key", "_box").agg(F.ceil(F.count(F.lit(1)) / TILE_ROWS).alias("_parts"), F.min(F.struct(*objectives)).alias("_point")))
    parts = boxes.select("_key", "_box", "_parts")
    tiles = cut_lineage(placed.join(parts.hint("merge"), ["_key", "_box"]).select(
        "_key", "_box", F.pmod(F.xxhash64(*objectives), F.col("_parts")).alias("_part"), F.lit(False).alias("_asks"), *objectives))

    def measure(rows: pd.DataFrame) -> pd.DataFrame:
        asks = rows["_asks"].to_numpy(dtype=bool)
        own, meets = rows.loc[asks, ["_key", *objectives]], rows.loc[~asks, objectives].to_numpy(dtype="float64").T
        values, out = own[objectives].to_numpy(dtype="float64").T, np.full(len(own), np.nan)
        for begin in range(0, len(own) if meets.shape[1] else 0, 256):
            some, gap = values[:, begin:begin + 256], 0.0
            with np.errstate(invalid="ignore", over="ignore"):
                for v, m in zip(some, meets):
                    gap = gap + (v[:, None] - m[None, :]) ** 2
            if skip_self:
                i, j = np.nonzero(gap == 0)
                same = (some[:, i] == meets[:, j]).all(axis=0)
                gap[i[same], j[same]] = np.nan
            out[begin:begin + 256] = np.sqrt(np.fmin.reduce(gap, axis=1))
        return own.assign(_d=out)[~np.isnan(out)]

    def visit(rows: DataFrame) -> DataFrame:
        sent = rows.join(parts.hint("merge"), ["_key", "_box"]).select(
            "_key", "_box", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("_part"), F.lit(True).alias("_asks"), *objectives)
        schema = "_key string, " + ", ".join(f"`{c}` double" for c in objectives) + ", _d double"
        met = tiles.unionByName(sent).groupBy("_key", "_box", "_part").applyInPandas(measure, schema)
        return met.groupBy("_key", *objectives).agg(F.min("_d").alias("_d"))

    def gap(p: Column) -> Column:
        off = F.sqrt(reduce(lambda a, b: a + b, [(p[c] - F.col(c)) * (p[c] - F.col(c)) for c in objectives]))
        return F.when(~reduce(lambda a, b: a & b, [p[c] == F.col(c) for c in objectives]), off) if skip_self else off

    at_home = cut_lineage(_in_boxes(asked, objectives, cuts, bins))
    first = cut_lineage(at_home.join(visit(at_home).hint("merge"), ["_key", *objectives], "left").select("_key", *objectives, "_d", F.col("_box").alias("_home")))
    lonely = first.where("_d is null").select("_key", *objectives)
    ranked = boxes.withColumn("_nth", F.row_number().over(Window.partitionBy("_key").orderBy(F.xxhash64("_box")))).where(F.col("_nth") <= GUARDS)
    few = ranked.groupBy("_key").agg(F.collect_list("_point").alias("_few"))  # GUARDS points a group
    bounded = lonely.join(few.hint("merge"), "_key").select("_key", *objectives, F.array_min(F.transform("_few", gap)).alias("_d"), F.lit(-1).cast("long").alias("_home"))
    bound = cut_lineage(first.unionByName(bounded).where("_d is not null"))
    further = _in_boxes(bound, objectives, cuts, bins, F.col("_d") * (1.0 + 1e-9)).where("_box <> _home").select("_key", "_box", *objectives)
    nearest = bound.join(visit(further).withColumnRenamed("_d", "_other").hint("merge"), ["_key", *objectives], "left").select(
        "_key", *objectives, F.least("_d", "_other").alias("nearest"))
    rows = targets.select(key, *by, *vectors).withColumn("_key", group).join(nearest.hint("merge"), ["_key", *objectives], "left").drop("_key")
    if skip_self:  # a copy elsewhere is at distance zero
        copied = points.where(F.col("_copies") > 1).select(*by, *objectives, F.lit(0.0).alias("_zero"))
        rows = rows.join(copied.hint("merge"), [*by, *objectives], "left").withColumn("nearest", F.coalesce("_zero", "nearest"))
    return rows.select(key, *by, "nearest")


def igd(found: DataFrame, reference_front: DataFrame, key: str, objectives: Sequence[str], by: str | None = None) -> DataFrame:
    """Mean distance from the reference front to the nearest found point; infinite if none was found.

    With ``by`` one row for each of its values in ``found`` (few), all in the same jobs.
    """
    mean = F.coalesce(F.avg("nearest"), F.lit(float("inf"))).alias("igd")
    if by is None:
        return nearest_distance(reference_front, found, key, objectives).agg(mean)
    asked = reference_front.select(key, *objectives).join(F.broadcast(found.select(by).distinct()))  # one row a group
    return nearest_distance(asked, found, key, objectives, by=[by]).groupBy(by).agg(mean)


def spacing(front: DataFrame, key: str, objectives: Sequence[str]) -> DataFrame:
    """Population deviation of nearest-neighbour distances; zero below two points."""
    near = nearest_distance(front, front, key, objectives, skip_self=True)
    return near.agg(F.coalesce(F.stddev_pop("nearest"), F.lit(0.0)).alias("spacing"))


def crowding(front: DataFrame, objectives: Sequence[str], key: str) -> DataFrame:
    """Add ``crowding``: normalised gap between neighbours summed over objectives, infinite at the ends."""
    front = cut_lineage(front)  # read once per objective below
    edges = front.agg(F.count(F.lit(1)).alias("_n"), *[
        (F.max(c) - F.min(c)).alias(f"_span_{c}") for c in objectives]).withColumn("_k", F.lit(1))
    rows = front.withColumn("_k", F.lit(1)).join(F.broadcast(edges), "_k").drop("_k")
    total = F.lit(0.0)
    for c in objectives:
        rows = with_neighbours(rows, c, key, f"_prev_{c}", f"_next_{c}")
        prev, following, span = F.col(f"_prev_{c}"), F.col(f"_next_{c}"), F.col(f"_span_{c}")
        total = total + F.when(prev.isNull() | following.isNull(), F.lit(float("inf"))).when(
            span > 0, (following - prev) / span).otherwise(0.0)
    rows = rows.withColumn("crowding", F.when(F.col("_n") <= 2, F.lit(float("inf"))).otherwise(total))
    return rows.select(*front.columns, "crowding")


def thin(front: DataFrame, objectives: Sequence[str], key: str, k: int) -> DataFrame:
    """The k most isolated plans."""
    return crowding(front, objectives, key).orderBy(F.desc("crowding"), key).limit(k)


def sort_by(front: DataFrame, column: str, key: str, name: str = "place") -> DataFrame:
    """Add the 0-based place in ascending order of a column."""
    ranked = global_rank(front, [column, key], "_place")
    return ranked.withColumn(name, F.col("_place") - 1).drop("_place")


def best_by(front: DataFrame, objectives: Sequence[str], key: str) -> DataFrame:
    return front.agg(*[F.min_by(key, F.struct(c, key)).alias(f"best_{c}") for c in objectives])


def update_archive(
    archive: DataFrame | None, candidates: DataFrame, objectives: Sequence[str], key: str,
    capacity: int | None = None, violation: str | None = None,
) -> DataFrame:
    """Merge feasible candidates, drop dominated plans and those nearly equal to one of a lesser key.

    Plans are nearly equal if no objective differs by more than 1e-5 of the larger value. All that is left
    stays, unless a ``capacity`` asks for the most spread plans only.
    """
    fresh = feasible(candidates, violation)
    pool = fresh if archive is None else archive.unionByName(fresh.select(*archive.columns))
    front = skyline(pool, objectives)
    kept = front.join(_nearly_equal(front, objectives, key), key, "left_anti").select(*front.columns)
    return cut_lineage(kept if capacity is None else thin(kept, objectives, key, capacity).drop("crowding"))


def _nearly_equal(front: DataFrame, objectives: Sequence[str], key: str, tolerance: float = 1e-5) -> DataFrame:
    """Keys of plans with a nearly equal plan of a lesser key.

    Values fall into steps of the tolerance on a logarithmic scale, so nearly equal plans are in the same or adjacent
    steps of every objective; one side looks into those, and the distance itself decides.
    """
    def step(c: str) -> Column:
        wide = F.floor(F.ln(F.abs(F.col(c))) / tolerance).cast("bigint")
        return F.when(F.col(c) == 0, F.struct(F.lit(0).alias("sign"), F.lit(0).cast("bigint").alias("step"))).otherwise(
            F.struct(F.signum(c).cast("int").alias("sign"), wide.alias("step")))

    rows = cut_lineage(front.select(key, *objectives, *[step(c).alias(f"_s{i}") for i, c in enumerate(objectives)]))
    around = rows
    for i in range(len(objectives)):
        near = F.array(*[F.struct(F.col(f"_s{i}.sign").alias("sign"), (F.col(f"_s{i}.step") + d).alias("step")) for d in (-1, 0, 1)])
        around = around.withColumn(f"_s{i}", F.explode(near))
    around = around.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(objectives)], *[F.col(f"_s{i}").alias(f"_t{i}") for i in range(len(objectives))])
    on = [F.col(f"_s{i}") == F.col(f"_t{i}") for i in range(len(objectives))]
    close = [F.abs(F.col(c) - F.col(f"_o{i}")) <= tolerance * F.greatest(F.abs(F.col(c)), F.abs(F.col(f"_o{i}"))) for i, c in enumerate(objectives)]
    met = reduce(lambda x, y: x & y, [*on, *close, F.col("_k") < F.col(key)])
    return rows.join(around, met).select(key).distinct()
