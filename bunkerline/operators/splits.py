"""Train/test splits of a ship-year panel that keep ships whole.

Order by md5(seed, ship) replaces a permutation drawn on one machine: the same ship gets the
same place on every run and engine, and ranks are computed bin by bin, not in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bunkerline.functions.ordering import global_rank


def ship_digest(seed: int, ship: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}-"), ship.cast("string")))


def ships_of(frame: DataFrame, group: str) -> DataFrame:
    return frame.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("rows"))


def split_by_vessel(frame: DataFrame, test_size: float = 0.25, seed: int = 1000, group: str = "imo") -> DataFrame:
    """Add ``split``: a share of whole ships, rounded up, is held out."""
    if not 0.0 < test_size < 1.0:
        raise ValueError(f"test_size must be inside (0, 1), not {test_size}")
    ships = ships_of(frame, group).select(group, ship_digest(seed, F.col(group)).alias("_h"))
    ranked = global_rank(ships, ["_h", group], "_place", total="_ships")
    held_out = F.ceil(F.lit(test_size) * F.col("_ships"))
    sides = ranked.select(
        group,
        F.when(F.col("_ships") < 2, F.raise_error(F.lit("a vessel split needs at least two ships")))
        .when(F.col("_place") <= held_out, "test").otherwise("train").alias("split"),
    )
    return frame.join(sides, group)


def split_by_time(frame: DataFrame, train_through: int, time: str = "reporting_period") -> DataFrame:
    """Add ``split``: later periods are the test side; ships may be on both."""
    out = frame.where(F.col(time).isNotNull()).withColumn(
        "split", F.when(F.col(time) <= train_through, "train").otherwise("test")
    )
    sides = out.groupBy("split").agg(F.min(time).alias("lo"), F.max(time).alias("hi")).collect()
    if len(sides) < 2:
        span = [(s["lo"], s["hi"]) for s in sides]
        raise ValueError(f"train_through={train_through} leaves an empty side; periods span {span}")
    return out


def split_by_vessel_and_time(
    frame: DataFrame, train_through: int, test_size: float = 0.25, seed: int = 1000,
    group: str = "imo", time: str = "reporting_period",
) -> DataFrame:
    """Unseen ships in unseen years; rows on the wrong side of the year cut are dropped."""
    early = F.col(time) <= train_through
    return split_by_vessel(frame, test_size, seed, group).where(
        ((F.col("split") == "train") & early) | ((F.col("split") == "test") & ~early)
    )


def grouped_folds(frame: DataFrame, k: int = 5, seed: int = 1000, group: str = "imo") -> DataFrame:
    """Add ``fold`` 0..k-1: whole ships, dealt in a snake from the most to the least filed."""
    ships = ships_of(frame, group).select("*", ship_digest(seed, F.col(group)).alias("_h"), (-F.col("rows")).alias("_fewer"))
    ranked = global_rank(ships, ["_fewer", "_h", group], "_place", total="_ships")
    place = F.col("_place") - 1
    lap, seat = F.floor(place / k), place % k
    dealt = ranked.select(
        group,
        F.when(F.col("_ships") < k, F.raise_error(F.lit(f"too few ships for {k} folds")).cast("int"))
        .when(lap % 2 == 0, seat).otherwise(k - 1 - seat).cast("int").alias("fold"),
    )
    return frame.join(dealt, group)


def leakage(frame: DataFrame, group: str = "imo", side: str = "split") -> DataFrame:
    """Ships present on more than one side."""
    return (
        frame.where(F.col(group).isNotNull()).groupBy(group)
        .agg(F.min(side).alias("_a"), F.max(side).alias("_b"))
        .where(F.col("_a") != F.col("_b")).select(group)
    )


def assert_no_leakage(frame: DataFrame, group: str = "imo", side: str = "split") -> None:
    shared = leakage(frame, group, side)
    found = shared.count()
    if found:
        examples = [r[0] for r in shared.orderBy(group).limit(5).collect()]
        raise ValueError(f"{found} ships on both sides, e.g. {examples}")


def summary(frame: DataFrame, group: str = "imo", side: str = "split") -> DataFrame:
    per_ship = frame.groupBy(side, group).agg(F.count(F.lit(1)).alias("n"))
    return per_ship.groupBy(side).agg(F.sum("n").alias("rows"), F.count(group).alias("ships"))
