"""Mixing overlapping sources to target weights.

Method: a min-cost flow. Documents are summed by membership pattern (the set of sources they belong to);
a pattern's words flow to its sources' quotas, the first copy of a word free, every further one dearer than the last,
up to `repeats` copies. The flow of a pattern's copy to its sources is then filled with documents in a seeded order: cumulative
sizes cut the order into one stretch for each source, and the words missing at a stretch's end go to the largest
unused documents that fit, `fills` times. What a source lacks after that goes to cumulative-sum passes over the unused documents that fit, in the
seeded order, until none fits: a source ends less than its smallest unused document below its quota.

The driver sees one row for each pattern and source, which is the mixture's definition and not its data. Cumulative sizes
come from sums per (pattern, bucket of the seeded hash) and a window within a bucket, so one source may hold any share of the rows. The passes sum per
source in the same way; each takes at least one document for a source that has one, and in a random order about halves what is missing or uses up what fits.

Defined cases: null and empty texts have size 0; a null source is a source, last in order; a document of no source, or of
sources without quota, is not taken; repeated rows are taken on their own; an empty table gives an empty result; all given columns stay,
whatever their names, but `size`, `takes` and `taken`, which are replaced.
"""

from __future__ import annotations

from collections import deque
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bunkerline.llm.common import store, tag

WORD = r"[^\x20\x09-\x0D]+"
BUCKET_DIGITS = 3


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> dict[str | None, float]:
    """Each source's target: `share` of all words dealt by weight, none above `most` times its size.

    What is cut off is dealt again by weight among the others until none is above.
    """
    ordered = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {name: weights[i % len(weights)] for i, (name, _) in enumerate(ordered)}
    size = dict(ordered)
    out: dict[str | None, float] = {}
    rest, open_ = share * sum(size.values()), list(size)
    while open_:
        total = sum(weight[s] for s in open_)
        above = [s for s in open_ if rest * weight[s] / total > most * size[s]]
        if not above:
            out |= {s: rest * weight[s] / total for s in open_}
            break
        out |= {s: most * size[s] for s in above}
        open_ = [s for s in open_ if s not in out]
        rest = share * sum(size.values()) - sum(out.values())
    return out


def flow(patterns: list[tuple[tuple, int]], quotas: dict, repeats: int = 2) -> dict[tuple[int, int, object], int]:
    """Words of (pattern, copy, source) in a cheapest largest flow.

    Successive cheapest paths: start, pattern (an edge for each copy at that copy's cost), source, end.
    """
    sources = list(quotas)
    count = 2 + len(patterns) + len(sources)
    end, first = count - 1, 1 + len(patterns)
    place = {s: first + i for i, s in enumerate(sources)}
    edges: list[list[int]] = []  # to, room, cost; each followed by its reverse
    out: list[list[int]] = [[] for _ in range(count)]

    def link(a: int, b: int, room: int, cost: int) -> int:
        out[a].append(len(edges))
        edges.append([b, room, cost])
        out[b].append(len(edges))
        edges.append([a, 0, -cost])
        return len(edges) - 2

    copies = [[link(0, 1 + i, size, 2**c - 1) for c in range(repeats)] for i, (_, size) in enumerate(patterns)]
    routes = [{s: link(1 + i, place[s], size * repeats, 0) for s in names if s in place} for i, (names, size) in enumerate(patterns)]
    for s in sources:
        link(place[s], end, int(quotas[s]), 0)
    while True:
        cost, via, queue, queued = [None] * count, [-1] * count, deque([0]), [False] * count
        cost[0] = 0
        while queue:
            a = queue.popleft()
            queued[a] = False
            for e in out[a]:
                b, room, c = edges[e]
                if room and (cost[b] is None or cost[a] + c < cost[b]):
                    cost[b], via[b] = cost[a] + c, e
                    if not queued[b]:
                        queue.append(b)
                        queued[b] = True
        if cost[end] is None:
            break
        path, node = [], end
        while node:
            path.append(via[node])
            node = edges[via[node] ^ 1][0]
        amount = min(edges[e][1] for e in path)
        for e in path:
            edges[e][1] -= amount
            edges[e ^ 1][1] += amount
    result = {}
    for i, _ in enumerate(patterns):  # deal each copy's words to the pattern's routes in order
        left = {s: edges[e ^ 1][1] for s, e in routes[i].items()}
        for c, e in enumerate(copies[i]):
            room = edges[e ^ 1][1]
            for s in left:
                amount = min(room, left[s])
                if amount:
                    result[i, c, s] = amount
                    left[s] -= amount
                    room -= amount
    return result


def mix(docs: DataFrame, size: Column, sources: Column, quotas: dict, key: str = "doc_id", seed: str = "mix", repeats: int = 2, fills: int = 4) -> DataFrame:
    """Add `size`, `takes` (the source each taken copy counts for) and `taken` (words, copies counted) to documents.

    `sources` is an array of names; `quotas` has each source's words. Columns of those three names are replaced.
    """
    t = tag()
    pat, h, b, cum, base, segs, own_row = (f"_{c}_{t}" for c in ("pattern", "hash", "bucket", "cum", "base", "segments", "row"))
    kind = docs.select(sources.alias("s")).schema["s"].dataType.simpleString()
    kept = [c for c in docs.columns if c not in ("size", "takes", "taken")]
    quoted = lambda c: "`" + c.replace("`", "``") + "`"
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(quoted(key)).cast("string"), F.lit("null"))))
    id_of = F.col(own_row).getField(key)  # a table's own columns travel in one struct, so no name of theirs meets one of the plan's
    rows = store(docs.select(F.struct(*(F.col(quoted(c)) for c in kept)).alias(own_row), size.alias("size"), F.coalesce(F.array_sort(F.array_distinct(sources)), F.array().cast(kind)).alias(pat), digest.alias(h)).withColumn(b, F.substring(h, 1, BUCKET_DIGITS)))
    sums = rows.groupBy(pat, b).agg(F.sum("size").alias(cum)).persist()
    patterns = [(tuple(r[pat] or ()), r["n"]) for r in sums.groupBy(pat).agg(F.sum(cum).alias("n")).collect()]
    dealt = flow(patterns, {s: int(q) for s, q in quotas.items()}, repeats)
    table = []
    for i, (names, _) in enumerate(patterns):
        own = []
        for c in range(repeats):
            stretch = [(s, n) for (p, copy, s), n in dealt.items() if p == i and copy == c]
            at = 0
            for k, (s, n) in enumerate(stretch):
                own.append((c, s, at, at + n, k, len(stretch)))
                at += n
        table.append((list(names), own))
    spark = docs.sparkSession
    name = docs.select(F.element_at(sources, 1).alias("s")).schema["s"].dataType.simpleString()
    plan = spark.createDataFrame(table, f"`{pat}` {kind}, `{segs}` array<struct<copy:int,source:{name},lo:long,hi:long,k:int,n:int>>")
    before = Window.partitionBy(pat).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(pat, b, F.coalesce(F.sum(cum).over(before), F.lit(0)).alias(base))
    order = Window.partitionBy(pat, b).orderBy(h, id_of, "size").rowsBetween(Window.unboundedPreceding, 0)
    same = lambda x, y: x[pat].eqNullSafe(y[pat])
    summed = rows.withColumn(cum, F.sum("size").over(order))
    placed = summed.join(bases, summed[pat].eqNullSafe(bases[pat]) & (summed[b] == bases[b])).drop(bases[pat]).drop(bases[b])
    placed = placed.withColumn(cum, F.col(cum) + F.col(base)).drop(base)
    placed = placed.join(F.broadcast(plan), same(placed, plan), "left").drop(plan[pat])
    inside = lambda s: (F.col(cum) - F.col("size") >= s["lo"]) & (F.col(cum) <= s["hi"])
    placed = store(placed.withColumn("takes", F.filter(segs, inside)))

    # what a stretch lacks goes, a document at a time, to the largest unused one that fits; stretches of one copy choose among different documents
    gaps = placed.select(pat, F.explode(F.transform("takes", lambda s: F.struct(s["copy"], s["k"]))).alias("s"), "size").groupBy(pat, "s").agg(F.sum("size").alias("n")).collect()
    filled = {(tuple(r[pat] or ()), r["s"]["copy"], r["s"]["k"]): r["n"] for r in gaps}
    lack = {(names, seg[0], seg[4]): seg[3] - seg[2] - filled.get((names, seg[0], seg[4]), 0) for (names, _), (_, own) in zip(patterns, table) for seg in own}
    free = placed.where(F.col("size") > 0).select(F.col(pat).alias(f"{pat}p"), "size", cum, F.explode(segs).alias("seg"), "takes")
    free = free.where(F.col(cum) % F.col("seg.n") == F.col("seg.k")).where(~F.exists("takes", lambda s: s["copy"] == F.col("seg.copy")))
    picked: list[tuple] = []
    spec = f"`{pat}` {kind}, copy int, k int, `{base}` long"
    for _ in range(fills):
        wanted = spark.createDataFrame([(list(names), c, k, n) for (names, c, k), n in lack.items() if n > 0], spec)
        used = spark.createDataFrame([(list(names), c, k, at) for names, c, k, at, _ in picked], spec)
        place = lambda t: free[f"{pat}p"].eqNullSafe(t[pat]) & (F.col("seg.copy") == t["copy"]) & (F.col("seg.k") == t["k"])  # noqa: B023, E731
        unused = free.join(F.broadcast(used), place(used) & (F.col(cum) == used[base]), "left_anti")
        fits = unused.join(F.broadcast(wanted), place(wanted) & (F.col("size") <= wanted[base]))
        best = fits.groupBy(f"{pat}p", "copy", "k").agg(F.max(F.struct(F.col("size").alias("n"), (-F.col(cum)).alias("c"), F.col("seg.source").alias("s"))).alias("b")).collect()
        for r in best:
            at = (tuple(r[f"{pat}p"] or ()), r["copy"], r["k"])
            picked.append((*at, -r["b"]["c"], r["b"]["s"]))
            lack[at] -= r["b"]["n"]
        if not best:
            break
    first = spark.createDataFrame([(list(names), at, (c, s)) for names, c, _, at, s in picked], f"`{pat}p` {kind}, `{base}` long, more struct<copy:int,source:{name}>")
    more = first.groupBy(f"{pat}p", base).agg(F.collect_list("more").alias("more"))

    # then whole passes: every unused document, in the copies its pattern's flow reaches, for any of its sources that still lacks its size
    missing = {s: int(q) - sum(seg[3] - seg[2] for _, own in table for seg in own if seg[1] == s) for s, q in quotas.items()}
    for (names, _), (_, own) in zip(patterns, table):
        for seg in own:
            missing[seg[1]] += lack[names, seg[0], seg[4]]
    known = list(quotas)
    reach = [(list(names), [known.index(s) for s in names if s in missing], 1 + max([seg[0] for seg in own], default=0)) for (names, _), (_, own) in zip(patterns, table)]
    reach = spark.createDataFrame(reach, f"`{pat}p` {kind}, open array<int>, most int")
    at = (F.col(pat).eqNullSafe(F.col(f"{pat}p"))) & (F.col(cum) == F.col(base))
    rest = placed.where(F.col("size") > 0).join(F.broadcast(more), at, "left").drop(f"{pat}p", base)
    gone = F.concat(*(F.coalesce(F.transform(c, lambda s: s["copy"]), F.array().cast("array<int>")) for c in ("takes", "more")))
    rest = rest.join(F.broadcast(reach), F.col(pat).eqNullSafe(F.col(f"{pat}p"))).withColumn("gone", gone)
    rest = rest.select(pat, cum, h, b, id_of.alias("key"), "size", "open", F.explode(F.array_except(F.sequence(F.lit(0), F.col("most") - 1), "gone")).alias("copy"))
    passes: list[DataFrame] = []
    while any(n > 0 for n in missing.values()):
        lacks = F.broadcast(spark.createDataFrame([([missing[s] for s in known],)], "lacks array<long>"))
        rest = rest.crossJoin(lacks).withColumn("fits", F.filter("open", lambda s: F.get("lacks", s) >= F.col("size"))).where(F.size("fits") > 0)
        turn = F.pmod(F.xxhash64(h, "copy", F.lit(len(passes))), F.greatest(F.size("fits"), F.lit(1))).cast("int")
        rest = rest.withColumn("to", F.get("fits", turn)).withColumn("lack", F.get("lacks", F.col("to"))).drop("lacks", "fits")
        earlier = Window.partitionBy("to").orderBy("copy", b).rowsBetween(Window.unboundedPreceding, -1)
        ahead = rest.groupBy("to", "copy", b).agg(F.sum("size").alias("n")).select("to", "copy", b, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ahead"))
        within = Window.partitionBy("to", "copy", b).orderBy(h, "key", "size", cum).rowsBetween(Window.unboundedPreceding, 0)
        rest = rest.withColumn("run", F.sum("size").over(within)).join(ahead, ["to", "copy", b])
        rest = store(rest.withColumn("taken", F.col("run") + F.col("ahead") <= F.col("lack")).drop("run", "ahead", "lack"))
        got = rest.where("taken").groupBy("to").agg(F.sum("size").alias("n")).collect()
        if not got:
            break
        for r in got:
            missing[known[r["to"]]] -= r["n"]
        passes.append(rest.where("taken").select(F.col(pat).alias(f"{pat}p"), F.col(cum).alias(base), "copy", "to"))
        rest = rest.where(~F.col("taken")).drop("taken", "to")
    if passes:
        numbers = spark.createDataFrame(list(enumerate(known)), f"to int, source {name}")
        later = reduce(DataFrame.union, passes).join(F.broadcast(numbers), "to").select(f"{pat}p", base, F.struct("copy", "source").alias("more"))
        picks = first.unionByName(later).groupBy(f"{pat}p", base).agg(F.collect_list("more").alias("more"))
    else:
        picks = F.broadcast(more)
    at = (F.col(pat).eqNullSafe(F.col(f"{pat}p"))) & (F.col(cum) == F.col(base)) & (F.col("size") > 0)
    done = placed.join(picks, at, "left")
    empty = F.array().cast(f"array<struct<copy:int,source:{name}>>")
    takes = F.concat(F.coalesce(F.transform("takes", lambda s: F.struct(s["copy"], s["source"])), empty), F.coalesce("more", empty))
    takes = F.transform(F.array_sort(takes), lambda s: s["source"])
    return done.select(f"{own_row}.*", "size", takes.alias("takes")).withColumn("taken", F.size("takes") * F.col("size"))
