"""Sharding by a hierarchical weighted hash tree.

Method: every node of a tree of regions, racks and shards has a weight. A row descends from the root;
at each node every child draws -ln(u) / weight with u a hash of the row's key and the child's name, and the
least draw wins. A child's share is its weight's, and a draw depends on nothing but key, child and weight: changing weights
below one node moves rows only among that node's children, and raising one child's weight only moves rows to it.

The place within a shard is a running number made of counts per (shard, task) and a row number within them, so no
shard is ordered as a whole. Everything is DataFrame functions.

Defined cases: a null key is a key like any other; repeated rows fall into one shard and get places of their own; an
empty table gives an empty result; all other columns stay, working columns cannot clash; children without a positive weight get nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bunkerline.llm.common import store, tag


@dataclass(frozen=True)
class Node:
    name: str
    weight: float
    children: tuple[Node, ...] = ()
    shard: int = -1

    def depth(self) -> int:
        return 1 + max((c.depth() for c in self.children), default=0)


#: The layout a cluster of shards starts with: regions, racks in each, shards in each rack.
LAYOUT = (2, 3, 4)


def topology(shards: int, layout: tuple[int, int, int] = LAYOUT) -> Node:
    """The tree of a number of shards.

    The first shards fill the layout in order. Each one beyond it is a region of its own, so that it draws
    rows straight from the root and none of them settles in another shard on its way down.
    """
    regions, racks, per_rack = layout
    base = min(shards, regions * racks * per_rack)
    tree: dict[int, dict[int, list[int]]] = {}
    for s in range(base):
        tree.setdefault(s // (racks * per_rack), {}).setdefault(s // per_rack, []).append(s)
    children = [
        Node(f"region-{r}", float(sum(map(len, own.values()))), tuple(
            Node(f"rack-{k}", float(len(leaves)), tuple(Node(f"shard-{s}", 1.0, shard=s) for s in leaves)) for k, leaves in own.items()
        ))
        for r, own in tree.items()
    ]
    children += [Node(f"region-of-shard-{s}", 1.0, shard=s) for s in range(base, shards)]
    return Node("root", float(shards), tuple(children))


def _draw(key: Column, node: Node) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(node.name)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(u) / F.lit(node.weight)


def _choice(key: Column, node: Node) -> Column:
    """The place of the child with the least draw."""
    live = [(i, c) for i, c in enumerate(node.children) if c.weight > 0]
    if len(live) == 1:
        return F.lit(live[0][0])
    return F.array_min(F.array(*(F.struct(_draw(key, c).alias("d"), F.lit(i).alias("i")) for i, c in live)))["i"]


def assign(df: DataFrame, tree: Node, key: str, out: str = "shard") -> DataFrame:
    """Add the shard of every row: one column of choices for each level of the tree, then the shard itself."""
    levels = [f"_level{k}_{tag()}" for k in range(tree.depth() - 1)]
    reached: list[tuple[Node, Column]] = [(tree, F.lit(True))]
    found: list[tuple[Column, int]] = []
    for level in levels:
        choice = F.lit(None).cast("int")
        following = []
        for node, here in reached:
            choice = F.when(here, _choice(F.col(key), node)).otherwise(choice)
            for i, child in enumerate(node.children):
                at = here & (F.col(level) == i)
                if child.children:
                    following.append((child, at))
                else:
                    found.append((at, child.shard))
        df = df.withColumn(level, choice)
        reached = following
    shard = F.lit(None).cast("int")
    for at, value in found:
        shard = F.when(at, F.lit(value)).otherwise(shard)
    return df.withColumn(out, shard).drop(*levels)


def number(df: DataFrame, shard: str = "shard", out: str = "slot") -> DataFrame:
    """Add a gapless running number within each shard.

    Rows are materialised with an id made of their task and position; the numbers of a task's rows start
    where the earlier tasks' rows of that shard end.
    """
    row, task, base, n = (f"_{c}_{tag()}" for c in ("row", "task", "base", "n"))
    rows = store(df.withColumn(row, F.monotonically_increasing_id())).withColumn(task, F.shiftright(row, 33))
    before = Window.partitionBy(shard).orderBy(task).rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy(shard, task).agg(F.count("*").alias(n)).select(shard, task, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(base))
    within = F.row_number().over(Window.partitionBy(shard, task).orderBy(row))
    numbered = rows.withColumn(n, within).join(bases, [shard, task])
    return numbered.select(*df.columns, (F.col(base) + F.col(n) - 1).cast("long").alias(out))
