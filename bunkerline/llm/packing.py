"""Best-fit packing of tokenised documents into sequences of a fixed width.

Method: best-two-fit. A sequence is filled greedily with the longest piece that still fits; then
its smallest piece is exchanged for two unpacked pieces whose sum fits the widened gap more
tightly. Pieces of one length are interchangeable, so the packing is planned on the histogram of
lengths (at most `width` numbers, the only thing the driver sees) as patterns with
multiplicities: repeating a pattern until one of its lengths runs out is what the sequential
algorithm does. Every piece then takes its place by its rank among the pieces of its length, a
rank made of a count per partition and a position within it, so no group is gathered anywhere.

Defined cases: a null or empty text is the end token alone; a null doc_id is kept; repeated rows are
packed once each; an empty table gives an empty result; further columns are ignored. Texts of any length
are cut into pieces of `width` tokens, and memory holds one document's tokens at a time.
"""

from __future__ import annotations

import bisect
import os
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bunkerline.llm.alignment import byte_letters
from bunkerline.llm.common import release, slices, store, tag

WIDTH = 2048
#: Words whose ids a worker remembers before it starts anew; bounds its memory, not its results.
REMEMBERED = 500_000

#: Words that neither the normaliser nor the pre-tokeniser changes or cuts.
PLAIN = re.compile("[a-zß-öø-ÿ]+")
#: The letters that stand for bytes in the vocabulary.
LETTERS = {byte: letter for letter, byte in byte_letters().items()}
LITTLE = sys.byteorder == "little"

PIECES = "doc_id {id}, piece int, start long, length long, ids binary"


class WordEncoder:
    """Ids of whole texts, word by word.

    The vocabulary's pre-tokeniser drops white space and never joins across it, so a text's ids are
    those of its white-space separated words in order, and a run of letters followed by stops is encoded
    as the letters and then the stops. Runs of small Latin letters are what normaliser and pre-tokeniser leave as they are, so their bytes'
    letters go to the merges at once. Texts that contain the opening of a special token go through the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.known: dict[bytes, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [(array("I", e.ids) if LITTLE else np.array(e.ids, "<u4")).tobytes() for e in found]

    def _learn(self, words: set[bytes]) -> None:
        known, split, needed = self.known, [], set()
        for w in words:
            core = w.rstrip(b".,!?")
            if len(core) != len(w) and core and core.decode("utf-8", "replace").isalpha():
                split.append((w, core, w[len(core):]))
                needed.update(split[-1][1:])
            else:
                needed.add(w)
        fresh = [w for w in needed if w not in known]
        texts = [w.decode("utf-8", "replace") for w in fresh]
        plain = [PLAIN.fullmatch(t) is not None for t in texts]
        rest = iter(self._encode([t for t, p in zip(texts, plain) if not p]))
        known.update((w, array("I", [x.id for x in self.merge(w.decode("latin-1").translate(LETTERS))]).tobytes() if p and LITTLE else self._encode([t])[0] if p else next(rest)) for w, t, p in zip(fresh, texts, plain))
        for w, core, stops in split:
            known[w] = known[core] + known[stops]

    def forget(self) -> None:
        """At the end of a task most words are of texts that will not come again."""
        if len(self.known) > REMEMBERED // 10:
            self.known = {}

    def __call__(self, text: bytes) -> bytes:
        """Little-endian 32-bit ids of a UTF-8 text."""
        if b"<|" in text:
            return self._encode([text.decode("utf-8", "replace")])[0]
        words, known = text.lower().split(), self.known
        ids = list(map(known.get, words))
        if None in ids:
            if len(known) > REMEMBERED:
                known.clear()
            self._learn({w for w in set(words) if w not in known})
            ids = map(known.__getitem__, words)
        return b"".join(ids)


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each vocabulary and worker process."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def tokenise(docs: DataFrame, vocabulary: str, width: int = WIDTH, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids) of every text; ids are little-endian 32-bit numbers."""
    kind = docs.schema[id_col].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                rows, piece, start, length, ids = [], [], [], [], []
                for row, text in enumerate(part.column("text").cast(pa.binary()).to_pylist()):
                    tokens = encode(text or b"") + end
                    for k, at in enumerate(range(0, len(tokens), 4 * width)):
                        own = tokens[at : at + 4 * width]
                        rows.append(row), piece.append(k), start.append(at // 4), length.append(len(own) // 4), ids.append(own)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())],
                    ["doc_id", "piece", "start", "length", "ids"],
                )
        encode.forget()
        release()

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, PIECES.format(id=kind))


def plan(counts: dict[int, int], width: int = WIDTH) -> list[tuple[list[int], int]]:
    """Patterns of lengths and how many sequences follow each, by best-two-fit."""
    left = {n: c for n, c in counts.items() if c}
    lengths = sorted(left)
    patterns = []
    while lengths:
        pattern, space, used = [], width, {}
        at = len(lengths) - 1
        while at >= 0:
            n = lengths[at]
            k = min(space // n, left[n])
            if k:
                pattern += [n] * k
                used[n] = k
                space -= n * k
            at = min(at, bisect.bisect_right(lengths, space)) - 1
        if space and len(pattern) > 0:
            _exchange(pattern, used, left, lengths, pattern[-1] + space)
        times = min(left[n] // k for n, k in used.items())
        patterns.append((pattern, times))
        for n, k in used.items():
            left[n] -= k * times
            if not left[n]:
                lengths.pop(bisect.bisect_left(lengths, n))
    return patterns


def _exchange(pattern: list[int], used: dict[int, int], left: dict[int, int], lengths: list[int], room: int) -> None:
    """Replace the last, smallest piece by the two unpacked ones that fill `room` best, if they fill it better."""
    smallest = pattern[-1]
    free = np.array([n for n in lengths[: bisect.bisect_left(lengths, room)] if left[n] > used.get(n, 0)])
    if not len(free):
        return
    partner = np.searchsorted(free, room - free, side="right") - 1
    single = np.array([left[int(n)] - used.get(int(n), 0) < 2 for n in free])
    own = (partner == np.arange(len(free))) & single
    partner[own] -= 1
    good = (partner >= 0) & (partner <= np.arange(len(free))) & (free < room)
    if not good.any():
        return
    sums = np.where(good, free + free[partner], 0)
    best = int(sums.argmax())
    if sums[best] <= smallest:
        return
    pattern.pop()
    used[smallest] -= 1
    if not used[smallest]:
        del used[smallest]
    for n in (int(free[best]), int(free[partner[best]])):
        pattern.append(n)
        used[n] = used.get(n, 0) + 1


def _runs(patterns: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: the first rank of each run of places, its first sequence, places a sequence, and their offsets."""
    runs: dict[int, list] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for pattern, times in patterns:
        offsets: dict[int, list[int]] = {}
        at = 0
        for n in pattern:
            offsets.setdefault(n, []).append(at)
            at += n
        for n, places in offsets.items():
            first = taken.get(n, 0)
            runs.setdefault(n, []).append((first, sequence, places))
            taken[n] = first + times * len(places)
        sequence += times
    return {
        n: (np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([len(r[2]) for r in rows]), np.cumsum([0] + [len(r[2]) for r in rows]), np.array([o for r in rows for o in r[2]]))
        for n, rows in runs.items()
    }


def place(pieces: DataFrame, width: int = WIDTH) -> DataFrame:
    """Add sequence_id and offset to pieces that have a `length` of 1 to `width`; their other columns stay."""
    columns, task_col, nth_col, base_col = pieces.columns, *(f"{c}_{tag()}" for c in ("task", "nth", "base"))
    spec = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(width + 1, np.int64)
        task = TaskContext.get().partitionId()
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column("length").to_numpy()
            order = np.argsort(n, kind="stable")
            of = n[order]
            first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            within = np.arange(len(of)) - np.repeat(first, np.diff(np.append(first, len(of))))
            nth = np.empty(len(of), np.int64)
            nth[order] = within + seen[of]
            np.add.at(seen, n, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(n), task, np.int32)), pa.array(nth)], [*batch.schema.names, task_col, nth_col])

    numbered = store(pieces.mapInArrow(number, f"{spec}, {task_col} int, {nth_col} long"))
    counts = numbered.groupBy("length", task_col).agg(F.count("*").alias(nth_col)).persist()
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum(nth_col).alias("n")).collect()}
    runs = _runs(plan(histogram, width))
    before = Window.partitionBy("length").orderBy(task_col).rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", task_col, F.coalesce(F.sum(nth_col).over(before), F.lit(0)).alias(base_col))

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("length").to_numpy()
            rank = batch.column(base_col).to_numpy() + batch.column(nth_col).to_numpy()
            sequence, offset = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
            for value in np.unique(n):
                own = np.flatnonzero(n == value)
                first, base, places, start, offsets = runs[int(value)]
                at = np.searchsorted(first, rank[own], side="right") - 1
                step = rank[own] - first[at]
                sequence[own] = base[at] + step // places[at]
                offset[own] = offsets[start[at] + step % places[at]]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(sequence), pa.array(offset)], [*columns, "sequence_id", "offset"])

    joined = numbered.join(bases, ["length", task_col]).select(*columns, base_col, nth_col)
    return joined.mapInArrow(locate, f"{spec}, sequence_id long, offset long")


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences themselves: (sequence_id, ids, doc_ids, starts), from pieces that still carry `ids`."""
    rows = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "start", "ids")))
    return placed.groupBy("sequence_id").agg(rows.alias("r")).select(
        "sequence_id", F.aggregate("r.ids", F.lit(b""), lambda a, b: F.concat(a, b)).alias("ids"), F.col("r.doc_id").alias("doc_ids"), F.col("r.offset").alias("starts")
    )
