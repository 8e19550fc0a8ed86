"""Document quality from a linear-chain conditional random field over lines.

Method: every line is good or bad. Its features and those of the lines before and after it score the two states,
a transition matrix scores neighbouring states, and forward-backward recursions give each line's probability of being bad. The mean
of these, weighted by the lines' lengths, is mapped to the document's quality by a logistic curve.

Only documents have labels. Training starts with each line labelled as its document; after each fit, lines
of bad documents that the model finds good are relabelled so, as long as one bad line is left. The sample is bounded
(`PER_CLASS` documents and `CLASS_LINES` lines a class, of which the driver gets feature vectors and no text; documents are taken whole, in the order of a hash of
their text, and one that would pass the bound on lines is left out of the sample); scoring covers every line of every text.

Defined cases: a null or empty text is one empty line; blank lines count only where nothing else is there; repeated rows and null ids are
scored like any other; an empty table gives an empty result; without labels of both classes every document gets one constant score;
only the named columns are read. Memory grows with one document's lines, not with a table.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bunkerline.llm.common import blobs, lists, release, slices
from bunkerline.llm.labelled import calibrate, probability, sample

PER_CLASS = 2000
CLASS_LINES = 200_000
ROUNDS, STEPS = 3, 150
_UPPER = string.ascii_uppercase.encode()
_DIGITS = string.digits.encode()
_SIGNS = b"!\"#$%&*+/<=>@[\\]^_`{|}~"
_CLUSTER = re.compile(rb"[!-/:-@\[-`{-~]{2,}(?=\s|$)")
FEATURES = 11


def line_features(line: bytes, seen: set[bytes]) -> list[float]:
    words = line.split()
    n, size = len(words) or 1, len(line) or 1
    less = lambda drop: (size - len(line.translate(None, drop))) / size if line else 0.0
    again = float(line in seen)
    seen.add(line)
    return [
        1.0, np.log1p(len(line)) / 8, len(set(words)) / n, sum(map(bytes.__eq__, words, words[1:])) / n,
        min(1.0, len(_CLUSTER.findall(line)) / n), less(_UPPER), less(_SIGNS), less(_DIGITS), line.count(b"|") / n, size / n / 16, again,
    ]


def document_lines(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows with those of both neighbours beside them, and the lengths of the lines."""
    lines = [x for x in text.split(b"\n") if x.strip()] or [b""]
    seen: set[bytes] = set()
    own = np.array([line_features(x, seen) for x in lines])
    edge = np.zeros((1, FEATURES))
    before, after = np.concatenate([edge, own[:-1]]), np.concatenate([own[1:], edge])
    return np.concatenate([own, before, after], axis=1), np.array([max(1, len(x)) for x in lines], float)


@dataclass
class Model:
    weights: np.ndarray  # score of "bad" over "good" by feature
    steps: np.ndarray  # scores of neighbouring states, [from, to]
    curve: tuple[float, float] = (1.0, 0.0)


class Chains:
    """Places of many chains' lines for recursions that advance all chains together.

    The longest chains come first, so that those still running at a step are always the first ones.
    """

    def __init__(self, lengths: np.ndarray):
        rank = np.empty(len(lengths), np.int64)
        rank[np.argsort(-lengths, kind="stable")] = np.arange(len(lengths))
        step = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.running = np.bincount(step).tolist()
        self.at = np.concatenate([[0], np.cumsum(self.running)]).astype(np.int64).tolist()
        self.place = np.array(self.at)[step] + np.repeat(rank, lengths)

    def marginals(self, scores: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each line's probability of being bad, and the summed probabilities of neighbouring states."""
        at, running = self.at, self.running
        flat = np.zeros((len(scores), 2))
        flat[self.place, 1] = np.clip(scores, -40, 40)
        local = np.exp(flat - flat.max(axis=1, keepdims=True))
        move = np.exp(steps - steps.max())
        forward, backward = np.empty_like(flat), np.ones_like(flat)
        for t, n in enumerate(running):
            own = local[at[t] : at[t] + n]
            a = own if t == 0 else own * (forward[at[t - 1] : at[t - 1] + n] @ move)
            forward[at[t] : at[t] + n] = a / a.sum(axis=1, keepdims=True)
        pairs = np.zeros((2, 2))
        for t in range(len(running) - 1, 0, -1):
            n = running[t]
            here, there = slice(at[t - 1], at[t - 1] + n), slice(at[t], at[t] + n)
            ahead = local[there] * backward[there]
            joint = forward[here][:, :, None] * move[None] * ahead[:, None, :]
            pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            b = ahead @ move.T
            backward[here] = b / b.sum(axis=1, keepdims=True)
        both = forward * backward
        return (both[:, 1] / both.sum(axis=1))[self.place], pairs


def fit(documents: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rounds: int = ROUNDS, iterations: int = STEPS, ridge: float = 1e-3) -> Model:
    """Conditional likelihood by Adam; label 1 is a good document."""
    width = documents[0][0].shape[1]
    rows = np.concatenate([f for f, _ in documents])
    lengths = np.array([len(f) for f, _ in documents])
    first, owner = np.cumsum(lengths) - lengths, np.repeat(np.arange(len(lengths)), lengths)
    inner = np.flatnonzero(owner[1:] == owner[:-1])
    layout = Chains(lengths)
    marks = 1.0 - labels[owner]
    weights, steps = np.zeros(width), np.zeros((2, 2))
    for again in range(rounds):
        seen = np.zeros((2, 2))
        np.add.at(seen, (marks[inner].astype(int), marks[inner + 1].astype(int)), 1)
        slow, fast = np.zeros(width + 4), np.zeros(width + 4)
        for k in range(1, iterations + 1):
            bad, pairs = layout.marginals(rows @ weights, steps)
            pull = np.concatenate([rows.T @ (marks - bad), (seen - pairs).ravel()]) / len(rows)
            pull -= ridge * np.concatenate([weights, steps.ravel()])
            slow, fast = 0.9 * slow + 0.1 * pull, 0.99 * fast + 0.01 * pull**2
            step = 0.2 * (slow / (1 - 0.9**k)) / (np.sqrt(fast / (1 - 0.99**k)) + 1e-8)
            weights, steps = weights + step[:width], steps + step[width:].reshape(2, 2)
        if again + 1 < rounds:
            single = 1 / (1 + np.exp(-np.clip(rows @ weights, -40, 40)))
            least = np.minimum(0.5, np.maximum.reduceat(single, first))
            marks = np.where(labels[owner] == 0, single >= least[owner], 0.0)
    model = Model(weights, steps)
    bad, _ = layout.marginals(rows @ weights, steps)
    model.curve = calibrate(quality(bad, np.concatenate([n for _, n in documents]), first), labels.astype(float))
    return model


def quality(bad: np.ndarray, sizes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The length-weighted mean of the lines' probabilities, on a scale that stretches small shares of bad lines; `first` has each document's first line."""
    return 1 - np.sqrt(np.add.reduceat(bad * sizes, first) / np.add.reduceat(sizes, first))


def _whole_documents(texts: DataFrame, class_lines: int) -> DataFrame:
    """Those (text, label) rows of a sample that stay within `class_lines` lines a class, whole documents each.

    The driver sees a number of lines for each text of the sample, which has a bounded number of rows.
    """
    name, lines = F.xxhash64("text", "label"), F.coalesce(F.regexp_count("text", F.lit("\n")), F.lit(0)) + 1
    sizes = sorted((r["label"], r["name"], r["lines"] * r["rows"]) for r in texts.groupBy("label", name.alias("name")).agg(F.max(lines).alias("lines"), F.count("*").alias("rows")).collect())
    left, out = {}, []
    for label, own, n in sizes:
        if n <= left.get(label, class_lines):
            left[label] = left.get(label, class_lines) - n
        else:
            out.append((own,))
    if not out:
        return texts
    return texts.withColumn("_name", name).join(F.broadcast(texts.sparkSession.createDataFrame(out, "_name long")), "_name", "left_anti").drop("_name")


def learn(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality", per_class: int = PER_CLASS, class_lines: int = CLASS_LINES) -> Model | None:
    """A model from the labels for which `usable` holds; None where they lack a class."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [document_lines(t) for t in blobs(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([f.astype("<f4").tobytes() for f, _ in found], pa.binary()), pa.array([n.tobytes() for _, n in found], pa.binary())], ["label", "features", "lengths"])

    texts = _whole_documents(sample(docs, labels, label, per_class, usable), class_lines)
    rows = texts.mapInArrow(scan, "label int, features binary, lengths binary").collect()
    rows.sort(key=lambda r: (r["label"], bytes(r["features"])))
    y = np.array([r["label"] for r in rows])
    if not len(y) or y.min() == y.max():
        return None
    documents = [(np.frombuffer(r["features"], "<f4").astype(float).reshape(-1, 3 * FEATURES), np.frombuffer(r["lengths"])) for r in rows]
    return fit(documents, y)


def score(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", lines: bool = True) -> DataFrame:
    """The kept columns with `score`, the quality of the document, and with `lines` also `bad`, each line's probability of being bad."""
    spec = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col, 2 << 20):
                found = [document_lines(t) for t in blobs(part.column(text_col))]
                lengths = np.array([len(n) for _, n in found])
                if model is None:
                    value, bad = np.full(len(found), 0.5), np.full(lengths.sum(), 0.5)
                else:
                    bad, _ = Chains(lengths).marginals(np.concatenate([f for f, _ in found]) @ model.weights, model.steps)
                    value = probability(quality(bad, np.concatenate([n for _, n in found]), np.cumsum(lengths) - lengths), model.curve)
                each = {"bad": lists(bad.astype(np.float32), lengths, pa.float32())} if lines else {}
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(value), *each.values()], [*keep, "score", *each])
        release()

    return docs.select(*dict.fromkeys([*keep, text_col])).mapInArrow(scan, f"{spec}score double{', bad array<float>' if lines else ''}")
