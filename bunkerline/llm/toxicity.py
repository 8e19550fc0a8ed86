"""Toxicity of whole texts from a weighted lexicon.

Method: a text is folded (case, widths, look-alike letters of other alphabets, digits and signs that stand for
letters, everything else to spaces) and an Aho-Corasick automaton finds the lexicon's word beginnings in it. The sum of the
terms' weights, without matches inside exception phrases, is divided by a slowly growing function of the text's length and mapped to
0..1 by a logistic curve.

The lexicon is learned: word beginnings and whole words that are far more frequent among toxic documents, weighted by their log odds.
Exception phrases are two-word phrases with a term that only clean documents have. Both come from counts made in Spark
over a bounded sample (`PER_CLASS` documents a class) of the usable labels; the texts are never collected. No number of terms is set:
what passes the least support and odds (terms) or the least count (phrases) is kept, so the sample alone bounds the lexicon.

Defined cases: null and empty texts have no matches and get the score of length 0; repeated rows and null ids are scored like any
other; an empty table gives an empty result; without usable labels the lexicon is empty; only `id_col` and `text_col` are read.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bunkerline.llm.common import slices
from bunkerline.llm.labelled import calibrate, probability, sample

PER_CLASS = 4000
#: Least share of the toxic sample a term must occur in, and least log odds.
SUPPORT, ODDS = 0.003, 3.0
STEMS = range(4, 11)

#: Letters of other alphabets and signs that look like Latin letters.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "ё": "e", "н": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "€": "e"}


class _Folds(dict):
    """A table for str.translate that fills itself."""

    def __missing__(self, code: int) -> str:
        char = unicodedata.normalize("NFKC", chr(code)).lower()
        base = "".join(LOOKALIKES.get(c, SUBSTITUTES.get(c, c)) for c in char)
        if not base.isalpha():
            base = "" if unicodedata.category(chr(code)) == "Cf" else " "
        self[code] = base
        return base


_folds = _Folds()


def fold(text: str) -> str:
    """Words of letters, each with one space before it, and one space at the end."""
    words = text.translate(_folds).split()
    return " " + " ".join(words) + " " if words else " "


def strength(weight: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Weight of the matches in proportion to a text's length, which counts by its logarithm."""
    return np.asarray(weight) / (1 + np.log1p(np.asarray(words) / 50))


@dataclass
class Lexicon:
    """Terms (a space, then the beginning of a word; a space after it if it is a whole word) with weights."""

    terms: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    curve: tuple[float, float] = (1.0, 0.0)

    def matcher(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for term, weight in self.terms.items():
            found.add_word(term, (len(term), weight))
        for phrase in self.exceptions:
            found.add_word(f" {phrase} ", (len(phrase) + 2, None))
        if self.terms:
            found.make_automaton()
        return found


def match(folded: str, automaton) -> tuple[float, list[str]]:
    """Summed weight and the terms that match outside of exception phrases."""
    if not len(automaton):
        return 0.0, []
    hits = [(end + 1 - n, end + 1, w) for end, (n, w) in automaton.iter(folded)]
    if not hits:
        return 0.0, []
    free = [(a, b) for a, b, w in hits if w is None]
    kept = {}
    for a, b, w in hits:
        if w is not None and not any(x <= a and b <= y for x, y in free):
            kept[a] = max(kept.get(a, (0.0, "")), (w, folded[a:b].strip()))
    return sum(w for w, _ in kept.values()), [t for _, t in kept.values()]


def _counts(texts: DataFrame) -> DataFrame:
    """(term, toxic, clean): in how many sampled documents of each class a word or word beginning occurs."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, Counter] = {0: Counter(), 1: Counter()}

        def flush() -> pa.RecordBatch:
            terms = list(counts[0].keys() | counts[1].keys())
            batch = pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([counts[1][t] for t in terms], pa.int64()), pa.array([counts[0][t] for t in terms], pa.int64())], ["term", "toxic", "clean"])
            counts[0].clear(), counts[1].clear()
            return batch

        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                words = set(fold(text or "").split())
                own = {f" {w} " for w in words} | {f" {w[:k]}" for w in words for k in STEMS if len(w) >= k}
                counts[label].update(own)
                if len(counts[0]) + len(counts[1]) > 400_000:
                    yield flush()
        yield flush()

    return texts.mapInArrow(scan, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def choose(rows: list[tuple[str, int, int]], toxic: int, clean: int) -> dict[str, float]:
    """The most specific of terms that occur in the same documents, and no term that another one begins."""
    by_term = {t: (a, b) for t, a, b in rows}
    longer: dict[str, int] = {}
    for t, (a, _) in by_term.items():
        for k in range(2, len(t)):
            longer[t[:k]] = max(longer.get(t[:k], 0), a)
    kept: dict[str, float] = {}
    for t in sorted(by_term, key=len):
        a, b = by_term[t]
        if longer.get(t, 0) >= 0.95 * a or any(t[:k] in kept for k in range(2, len(t))):
            continue
        kept[t] = float(np.log((a + 0.5) / (toxic + 1)) - np.log((b + 0.5) / (clean + 1)))
    return kept


def learn(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "toxic", per_class: int = PER_CLASS) -> Lexicon:
    """Lexicon, exceptions and curve from the labels for which `usable` holds."""
    texts = sample(docs, labels, label, per_class, usable).persist()
    sizes = {r["label"]: r["n"] for r in texts.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    best = _counts(texts).where((F.col("toxic") >= max(4, SUPPORT * toxic)) & (odds >= ODDS)).orderBy(F.desc("toxic"), "term")
    lexicon = Lexicon(choose([tuple(r) for r in best.collect()], toxic, clean))

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, counts = lexicon.matcher(), Counter()
        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                words = fold(text or "").split()
                hit = [len(automaton) > 0 and match(f" {w} ", automaton)[0] > 0 for w in words]
                counts.update({(f"{a} {b}", y) for a, b, h, k in zip(words, words[1:], hit, hit[1:]) if h or k})
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in counts], pa.string()), pa.array([y for _, y in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())], ["phrase", "label", "n"])

    found = texts.mapInArrow(phrases, "phrase string, label int, n long").groupBy("phrase").agg(F.sum(F.col("n") * F.col("label")).alias("toxic"), F.sum(F.col("n") * (1 - F.col("label"))).alias("clean"))
    lexicon.exceptions = [r["phrase"] for r in found.where("toxic = 0 and clean >= 3").orderBy(F.desc("clean"), "phrase").collect()]  # of the sample only
    points = _weigh(texts.select(F.col("label").cast("long").alias("key"), "text"), lexicon).select("key", "weight", "words").collect()  # at most 2 x per_class numbers
    y = np.array([r["key"] for r in points], float)
    lexicon.curve = calibrate(strength(np.array([r["weight"] for r in points]), np.array([r["words"] for r in points])), y)
    return lexicon


def _weigh(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    kind = docs.schema["key"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.matcher()
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                folded = [fold(t or "") for t in part.column("text").to_pylist()]
                found = [match(f, automaton) for f in folded]
                words = np.array([f.count(" ") - 1 for f in folded], np.int64)
                weight = np.array([w for w, _ in found], np.float64)
                score = probability(strength(weight, words), lexicon.curve)
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(weight), pa.array(words), pa.array(score), pa.array([t for _, t in found], pa.list_(pa.string()))], ["key", "weight", "words", "score", "terms"])

    return docs.mapInArrow(scan, f"key {kind}, weight double, words long, score double, terms array<string>")


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, weight, words, score, terms) of every document; terms are the matches, in the folded spelling."""
    return _weigh(docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")), lexicon).withColumnRenamed("key", id_col)
