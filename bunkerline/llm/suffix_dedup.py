"""Removal of repeated byte strings with suffix arrays built by linear grouping.

A byte goes if a window of `length` bytes covers it that starts anywhere else too, in the same document
or another.

Method: `suffix_array` groups suffixes by their longest Lyndon prefix. Groups are taken in descending
order; the members' previous-smaller pointers name the suffixes whose prefix the group's prefix extends, and
those move to new groups right above their old ones. A second pass emits suffixes in ascending order: each emitted
suffix lets the suffixes it is the next smaller one of take the next place of their group. Nothing is renamed recursively.

One array over the whole corpus would be one task, so the suffixes are dealt out first. Every window
has an anchor: the leftmost least hash among its substrings of `anchor` bytes, which equal windows share. Consecutive windows
with one anchor form a context. Contexts are grouped by the anchor's hash: equal contexts are counted, not repeated; a group of
one distinct context is settled by its count; every other group's distinct contexts are joined into one string, what all of them share around the
anchor written as one symbol, and a window repeats if a neighbour of its suffix in the array shares it entirely. A group with more distinct
contexts than `most` (one passage in a large share of all documents) counts its windows one by one instead, as rows, so it never meets in a task.

Defined cases: a null text is empty; texts shorter than `length` lose nothing; a row that repeats entirely
counts as another start, so both lose their long texts; a null doc_id is kept; an empty table gives an empty result; other columns
stay. Long texts are cut into overlapping blocks, so memory does not grow with them.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bunkerline.llm.common import blobs, signed, slices, stash, tag

LENGTH, ANCHOR = 400, 200
#: Distinct contexts of one anchor that one task sorts; larger groups count windows as rows.
MOST = 4096
BLOCK = 1 << 18
_MULTIPLIER = 0x9E3779B97F4A7C15
_PLACE = np.uint64((1 << 24) - 1)


def suffix_array(text: Sequence[int]) -> list[int]:
    """Starts of the suffixes of a sequence of numbers in ascending order; a suffix sorts before its extensions."""
    n = len(text)
    symbols = sorted(set(text))
    name = {c: g for g, c in enumerate(symbols)}
    group = array("i", [name[c] for c in text])
    members: list[list[int] | int] = [[] for _ in symbols]
    for i, g in enumerate(group):
        members[g].append(i)
    below = array("i", range(-1, len(symbols) - 1))
    above = array("i", range(1, len(symbols) + 1))
    smaller = array("i", bytes(4 * n))
    done = bytearray(n)
    g = len(symbols) - 1
    while g >= 0:
        own = [i for i in members[g] if group[i] == g]
        members[g] = len(own)  # of a finished group only the size is needed
        extended = []
        for i in own:
            done[i] = 1
        for i in own:
            j = i - 1
            while j >= 0 and done[j]:
                j = smaller[j]
            smaller[i] = j
            if j >= 0:
                extended.append(j)
        if extended:
            for level in _by_count(extended):
                moved: dict[int, int] = {}
                for p in level:
                    old = group[p]
                    new = moved.get(old)
                    if new is None:
                        new = moved[old] = len(members)
                        members.append([])
                        up = above[old]
                        below.append(old)
                        above.append(up)
                        above[old] = new
                        below[up] = new
                    group[p] = new
                    members[new].append(p)
        g = below[g]
    return _emit(n, group, members, below, smaller, g_last=len(symbols) - 1)


def _by_count(ascending: list[int]) -> list[list[int]]:
    """The distinct values, those that occur most often first."""
    distinct = list(dict.fromkeys(ascending))
    if len(distinct) == len(ascending):
        return [distinct]
    counts: dict[int, int] = {}
    for p in ascending:
        counts[p] = counts.get(p, 0) + 1
    levels: dict[int, list[int]] = {}
    for p, c in counts.items():
        levels.setdefault(c, []).append(p)
    return [levels[c] for c in sorted(levels, reverse=True)]


def _emit(n: int, group: array, sizes: list[int], below: array, smaller: array, g_last: int) -> list[int]:
    free = array("i", bytes(4 * len(sizes)))
    end, g = n, g_last
    while g >= 0:
        end -= sizes[g]
        free[g] = end
        g = below[g]
    order = array("i", bytes(4 * n))
    placed = bytearray(n)
    for k in range(-1, n):
        j = (n if k < 0 else order[k]) - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            order[free[g]] = j
            free[g] += 1
            placed[j] = 1
            j = smaller[j]
    return order.tolist()


class Windows:
    """Finds the contexts of texts: runs of windows that share their anchor."""

    def __init__(self, length: int, anchor: int):
        self.length, self.anchor = length, anchor
        size = BLOCK + 2 * length + 1
        step = lambda m: np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size, m, np.uint64)]))
        self.powers, self.inverse = step(np.uint64(_MULTIPLIER)), step(np.uint64(pow(_MULTIPLIER, -1, 1 << 64)))

    def blocks(self, texts: list[bytes]) -> Iterator[tuple[bytes, np.ndarray]]:
        """Joined pieces of texts and, by piece, (row, offset in the text, start, end in the block)."""
        parts, pieces, at = [], [], 0
        for row, text in enumerate(texts):
            for offset in range(0, max(0, len(text) - self.length + 1), BLOCK):
                piece = text[offset : offset + BLOCK + self.length - 1]
                if at and at + len(piece) > BLOCK + self.length:
                    yield b"".join(parts), np.array(pieces)
                    parts, pieces, at = [], [], 0
                parts.append(piece)
                pieces.append((row, offset, at, at + len(piece)))
                at += len(piece)
        if parts:
            yield b"".join(parts), np.array(pieces)

    def contexts(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
        """Arrays (row, start, windows, anchor's place in the context, anchor's hash, hash of the context)."""
        k, length = self.anchor, self.length
        for block, pieces in self.blocks(texts):
            n = len(block)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum((np.frombuffer(block, np.uint8).astype(np.uint64) + np.uint64(1)) * self.inverse[:n], out=sums[1:])
            h = (sums[k:] - sums[:-k]) * self.powers[: n - k + 1]
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
            least = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
            width, span = length - k + 1, 1
            while 2 * span <= width:
                least = np.minimum(least[:-span], least[span:])
                span *= 2
            if span < width:
                least = np.minimum(least[: len(least) - width + span], least[width - span :])
            marks = np.zeros(n + 1, np.int8)
            marks[pieces[:, 2]] += 1
            np.add.at(marks, pieces[:, 3] - length + 1, -1)
            starts = np.flatnonzero(np.cumsum(marks[: n - length + 1], dtype=np.int64))
            place = (least[starts] & _PLACE).astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)]))
            count = np.diff(np.append(first, len(starts)))
            start, place = starts[first], place[first]
            piece = np.searchsorted(pieces[:, 2], start, side="right") - 1
            digest = xxhash.xxh3_64_intdigest
            ends = (start + count - 1 + length).tolist()
            hashes = np.array([digest(block[a:b]) for a, b in zip(start.tolist(), ends)], np.uint64)
            yield pieces[piece, 0], start - pieces[piece, 2] + pieces[piece, 1], count, place - start, h[place].view(np.int64), hashes.view(np.int64)


def _shared(parts: list[bytes]) -> int:
    """Length of the longest prefix common to all parts."""
    a, b = min(parts), max(parts)
    if a == b[: len(a)]:
        return len(a)
    lo, hi = 0, len(a) - 1
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[:mid] == b[:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def repeated_starts(contexts: list[tuple[int, int, int, bytes]], length: int, anchor: int) -> list[list[tuple[int, int]]]:
    """For distinct contexts (copies, windows, anchor's place, bytes) of one anchor: ranges of windows that occur again.

    The string that is sorted has each context without what all share next to the anchor: the bytes before,
    one symbol for the shared stretch, the bytes after, a separator.
    """
    if all(c[0] > 1 for c in contexts):
        return [[(0, c[1])] for c in contexts]
    before = [c[3][: c[2]] for c in contexts]
    after = [c[3][c[2] + anchor :] for c in contexts]
    left, right = _shared([b[::-1] for b in before]), _shared(after)
    plain = max(max(b, default=0) for c in contexts for b in (c[3],)) < 0xF8
    core, stop = (0xFF, 0xF8) if plain else (256, 257)
    symbols: list[int] = []
    firsts, cores = [], []
    for b, a in zip(before, after):
        firsts.append(len(symbols))
        symbols += b[: len(b) - left]
        cores.append(len(symbols))
        symbols.append(core)
        symbols += a[right:]
        symbols.append(stop)
    text: Sequence[int] = bytes(symbols) if plain else symbols
    order = array("i", suffix_array(text))
    rank = array("i", bytes(4 * len(order)))
    for k, i in enumerate(order):
        rank[i] = k
    last = len(order) - 1

    def neighbours(i: int) -> list[int]:
        k = rank[i]
        return ([order[k - 1]] if k else []) + ([order[k + 1]] if k < last else [])

    found = []
    for (copies, windows, at, _), first, middle in zip(contexts, firsts, cores):
        if copies > 1:
            found.append([(0, windows)])
            continue
        near = neighbours(middle)
        ranges: list[tuple[int, int]] = []
        for i in range(windows):
            lead = at - i
            tail = max(0, length - lead - anchor - right)
            if lead > left:
                here, need = first + i, lead - left + 1 + tail
                others = neighbours(here)
            else:
                here, need, others = middle, 1 + tail, near
            own = text[here : here + need]
            if any(text[j : j + need] == own for j in others):
                if ranges and ranges[-1][1] == i:
                    ranges[-1] = (ranges[-1][0], i + 1)
                else:
                    ranges.append((i, i + 1))
        found.append(ranges)
    return found


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of half-open ranges; touching ranges join."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_RANGES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_RANGES_DDL = "array<struct<start:long,end:long>>"
_KEY = ["k1", "k2"]


def _find(docs: DataFrame, length: int, anchor: int) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(length, anchor)
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                for row, *found in windows.contexts(list(blobs(part.column("text")))):
                    row = pa.array(row)
                    yield pa.RecordBatch.from_arrays([part.column("k1").take(row), part.column("k2").take(row), *map(pa.array, found)], ["k1", "k2", "lo", "n", "at", "anchor", "context"])

    return docs.select("k1", "k2", "text").mapInArrow(scan, "k1 long, k2 long, lo long, n long, at long, anchor long, context long")


def _sorted_groups(contexts: DataFrame, length: int, anchor: int) -> DataFrame:
    """Ranges of repeated windows of each context, group by group as they stream past in order."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, group, done = None, {}, []

        def settle() -> None:
            members = list(group.items())
            for (context, _), ranges in zip(members, repeated_starts([m[1] for m in members], length, anchor)):
                done.append((names, context, [{"start": a, "end": b} for a, b in ranges]))

        def flush() -> pa.RecordBatch:
            rows = list(zip(*done)) or [(), (), ()]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], _RANGES)], ["anchor", "context", "ranges"])

        for batch in batches:
            for a, c, m, n, at, b in zip(*(batch.column(x).to_pylist() for x in ("anchor", "context", "copies", "n", "at", "bytes"))):
                if a != names:
                    if group:
                        settle()
                    names, group = a, {}
                group[c] = (m, n, at, b)
            yield flush()
        if group:
            settle()
        yield flush()

    ordered = contexts.repartition("anchor").sortWithinPartitions("anchor", "context")
    return ordered.mapInArrow(scan, f"anchor long, context long, ranges {_RANGES_DDL}")


def _counted_groups(contexts: DataFrame, length: int) -> DataFrame:
    """The same for contexts of large groups: their windows are counted as rows, combined before they are shuffled."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            for a, c, m, n, b in zip(*(batch.column(x).to_pylist() for x in ("anchor", "context", "copies", "n", "bytes"))):
                hashes = [signed(digest(b[i : i + length])) for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array([a] * n), pa.array([c] * n), pa.array(range(n), pa.int64()), pa.array([m] * n, pa.int64()), pa.array(hashes, pa.int64())], ["anchor", "context", "i", "copies", "window"])

    rows = contexts.mapInArrow(expand, "anchor long, context long, i long, copies long, window long")
    again = rows.groupBy("anchor", "window").agg(F.sum("copies").alias("all")).where("all > 1").drop("all")
    hits = rows.join(again, ["anchor", "window"]).groupBy("anchor", "context")
    return hits.agg(F.collect_list(F.struct(F.col("i").alias("start"), (F.col("i") + 1).alias("end"))).alias("ranges"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, most: int = MOST) -> DataFrame:
    """Merged byte spans (k1, k2, spans) to remove, from documents (k1, k2, text); the keys name a text."""
    found = stash(_find(docs, length, anchor))
    groups = found.groupBy("anchor").agg(F.count("*").alias("all"), F.min("context").alias("a"), F.max("context").alias("b")).where("all > 1")
    groups = stash(groups.select("anchor", (F.col("a") != F.col("b")).alias("differ")))  # as a table, so that the join may split a common anchor
    kept = stash(found.join(groups, "anchor"))
    distinct = kept.where("differ").groupBy("anchor", "context").agg(F.count("*").alias("copies"), F.min(F.struct("k1", "k2", "lo", "n", "at")).alias("r"))
    sizes = distinct.groupBy("anchor").agg((F.count("*") > most).alias("large"))
    chosen = distinct.join(sizes, "anchor").select("r.k1", "r.k2", F.struct("anchor", "context", "copies", "r.lo", "r.n", "r.at", "large").alias("c"))
    wanted = chosen.groupBy(*_KEY).agg(F.collect_list("c").alias("c"))
    cut = docs.join(wanted, _KEY).select(F.col("text").cast("binary").alias("b"), F.explode("c").alias("c"))
    cut = cut.select("c.*", F.substring("b", F.col("c.lo").cast("int") + 1, F.col("c.n").cast("int") + length - 1).alias("bytes"))
    cut = stash(cut)
    ranges = _sorted_groups(cut.where("not large"), length, anchor).unionByName(_counted_groups(cut.where("large").dropDuplicates(["anchor", "context"]), length))
    varied = kept.where("differ").join(ranges, ["anchor", "context"]).select(*_KEY, "lo", F.explode("ranges").alias("s"))
    starts = varied.select(*_KEY, (F.col("lo") + F.col("s.start")).alias("start"), (F.col("lo") + F.col("s.end")).alias("end"))
    alike = kept.where("not differ").select(*_KEY, F.col("lo").alias("start"), (F.col("lo") + F.col("n")).alias("end"))
    every = starts.unionByName(alike).groupBy(*_KEY).agg(F.collect_list(F.struct("start", (F.col("end") + length - 1).alias("end"))).alias("spans"))

    def join_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"start": a, "end": b} for a, b in merge([(s["start"], s["end"]) for s in own])] for own in batch.column("spans").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), pa.array(spans, _RANGES)], ["k1", "k2", "spans"])

    return every.mapInArrow(join_spans, f"k1 long, k2 long, spans {_RANGES_DDL}")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, anchor: int = ANCHOR, most: int = MOST, whole_characters: bool = False) -> DataFrame:
    """Documents with `kept` (the remaining bytes) and `spans` (the removed ranges); columns of those names are replaced.

    With `whole_characters`, a character that a span covers only in part stays, so that `kept` is UTF-8 again.
    """
    k1, k2, t = (f"{c}_{tag()}" for c in ("k1", "k2", "text"))
    columns = [c for c in docs.columns if c not in ("kept", "spans")]
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(*columns, F.xxhash64(F.col(id_col)).alias(k1), F.xxhash64(text).alias(k2))
    plain = keyed.select(F.col(k1).alias("k1"), F.col(k2).alias("k2"), text.alias("text"))
    spans = repeated_spans(plain, length, anchor, most).withColumnsRenamed({"k1": k1, "k2": k2, "spans": t})
    joined = keyed.join(spans, [k1, k2], "left").select(*columns, t)
    spec = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                kept, removed = [], []
                for text, own in zip(blobs(part.column(text_col)), part.column(t).to_pylist()):
                    ranges = [(s["start"], s["end"]) for s in own or ()]
                    if whole_characters:
                        ranges = [r for r in (_inner(text, a, b) for a, b in ranges) if r[0] < r[1]]
                    at, pieces = 0, []
                    for a, b in ranges:
                        pieces.append(text[at:a])
                        at = b
                    kept.append(b"".join([*pieces, text[at:]]))
                    removed.append([{"start": a, "end": b} for a, b in ranges])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(kept, pa.binary()), pa.array(removed, _RANGES)], [*columns, "kept", "spans"])

    return joined.mapInArrow(cut, f"{spec}, kept binary, spans {_RANGES_DDL}")


def _inner(text: bytes, a: int, b: int) -> tuple[int, int]:
    while a < b and text[a] & 0xC0 == 0x80:
        a += 1
    while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
        b -= 1
    return a, b
