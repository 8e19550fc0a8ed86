"""Toxicity and quality: parts against brute force, and held-out accuracy on whole tables."""

import itertools
import zlib

import numpy as np
import pytest

from bunkerline.llm import labelled, line_crf, toxicity
from bunkerline.llm.queries import QUERIES


def held_out(spark, folder, name, label):
    scored = {r["doc_id"]: r for r in QUERIES[name](spark, folder).collect()}
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    return scored, [(labels[d], r) for d, r in scored.items() if d in labels and r["held_out"]]


@pytest.mark.parametrize("name, label, of, held, least", [("op2_toxicity", "toxic", 3, 1, 0.93), ("op10_line_crf", "quality", 4, 2, 0.9)])
def test_held_out_accuracy(spark, small_dir, name, label, of, held, least):
    folder = small_dir.replace("sf0.001", "sf0.01")
    scored, pairs = held_out(spark, folder, name, label)
    assert len(scored) == spark.read.parquet(f"{folder}/documents.parquet").count()
    for d, r in scored.items():
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % of == held) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
    assert np.mean([r["predicted"] == y for y, r in pairs]) >= least
    assert len({r["score"] for _, r in pairs}) > 5


def test_labels_of_held_out_rows_do_not_matter(spark, small_dir):
    docs, labels = (spark.read.parquet(f"{small_dir}/{t}.parquet") for t in ("documents", "labels"))
    usable = labelled.remainder(labels["doc_id"], 3) != 1
    turned = labels.withColumn("toxic", toxicity.F.when(usable, labels["toxic"]).otherwise(1 - labels["toxic"]))
    a, b = toxicity.learn(docs, labels, usable), toxicity.learn(docs, turned, usable)
    assert a == b


def test_folding():
    assert toxicity.fold("ＬＯＳＥＲ, l0$er; Іdіоt!  été—x3no") == " loser loser idiot été xeno "
    assert toxicity.fold("") == " " and toxicity.fold(" .. ") == " "


def test_matches_against_a_plain_search():
    lexicon = toxicity.Lexicon({" trash": 2.0, " trash ": 3.0, " clown": 1.5}, ["no clown"])
    automaton = lexicon.matcher()
    assert toxicity.match(toxicity.fold("Trashy tr4sh, nontrash"), automaton) == (5.0, ["trash", "trash"])
    assert toxicity.match(toxicity.fold("no clown here, clowns"), automaton) == (1.5, ["clown"])
    assert toxicity.match(" ", toxicity.Lexicon({}).matcher()) == (0.0, [])


def test_most_specific_terms_are_chosen():
    rows = [(" tra", 9, 0), (" tras", 9, 0), (" trash", 9, 0), (" trash ", 4, 0), (" low", 8, 0), (" lowa", 4, 0)]
    assert set(toxicity.choose(rows, 10, 10)) == {" trash", " low"}


def brute_chain(scores, steps):
    """Marginals and pair sums of one chain by listing all paths."""
    n = len(scores)
    bad, pairs, total = np.zeros(n), np.zeros((2, 2)), 0.0
    for path in itertools.product((0, 1), repeat=n):
        w = np.exp(sum(s for s, y in zip(scores, path) if y) + sum(steps[a, b] for a, b in zip(path, path[1:])))
        total += w
        bad += w * np.array(path)
        for a, b in zip(path, path[1:]):
            pairs[a, b] += w
    return bad / total, pairs / total


def test_recursions_against_all_paths():
    rng = np.random.default_rng(3)
    lengths = np.array([1, 5, 3, 7, 3])
    scores, steps = rng.normal(size=lengths.sum()) * 2, rng.normal(size=(2, 2))
    bad, pairs = line_crf.Chains(lengths).marginals(scores, steps)
    want = [brute_chain(s, steps) for s in np.split(scores, np.cumsum(lengths)[:-1])]
    assert np.allclose(bad, np.concatenate([b for b, _ in want])) and np.allclose(pairs, sum(p for _, p in want))


def test_fit_finds_planted_lines():
    rng = np.random.default_rng(1)
    documents, labels = [], []
    for d in range(120):
        n, y = rng.integers(1, 8), d % 2
        x = rng.normal(size=(n, 2)) * 0.3
        x[:, 0] += 0.0 if y else 2.0 * (np.arange(n) >= n // 2)
        documents.append((np.concatenate([np.ones((n, 1)), x], axis=1), np.ones(n)))
        labels.append(y)
    model = line_crf.fit(documents, np.array(labels), iterations=60)
    lengths = np.array([len(f) for f, _ in documents])
    bad, _ = line_crf.Chains(lengths).marginals(np.concatenate([f for f, _ in documents]) @ model.weights, model.steps)
    score = labelled.probability(line_crf.quality(bad, np.ones(len(bad)), np.cumsum(lengths) - lengths), model.curve)
    assert np.mean((score > 0.5) == np.array(labels)) > 0.95


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (1, "", "x"), (None, "a\n\n b", "x"), (None, "a\n\n b", "x"), (7, "l0ser " * 5000, "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1, 0), (7, 0, 1), (None, 1, 0), (99, None, None)], "doc_id long, quality int, toxic int")
    usable = labelled.F.lit(True)
    out = toxicity.score(docs, toxicity.learn(docs, labels, usable)).collect()
    assert len(out) == 5 and all(0 <= r["score"] <= 1 for r in out)
    model = line_crf.learn(docs, labels, usable)
    out = line_crf.score(docs, model).collect()
    assert len(out) == 5 and all(0 <= r["score"] <= 1 for r in out) and [len(r["bad"]) for r in out] == [1, 1, 2, 2, 1]
    assert line_crf.learn(docs, labels.where("quality = 1"), usable) is None
    assert {r["score"] for r in line_crf.score(docs, None).collect()} == {0.5}
    assert toxicity.score(docs.limit(0), toxicity.Lexicon({})).count() == line_crf.score(docs.limit(0), model).count() == 0
    assert toxicity.learn(docs, labels.limit(0), usable).terms == {}


def test_sample_keeps_whole_documents_within_its_lines(spark):
    rows = [(f"d{i}\n" * 9, i % 2) for i in range(40)] + [("x\n" * 5000, 1), (None, 0)]
    texts = spark.createDataFrame(rows, "text string, label int")
    assert line_crf._whole_documents(texts, 10_000).count() == len(rows)
    kept = line_crf._whole_documents(texts, 100).collect()
    assert {tuple(r) for r in kept} < set(rows) and all(r["text"] is None or len(r["text"]) < 100 for r in kept)
    for y in (0, 1):
        n = sum((r["text"] or "").count("\n") + 1 for r in kept if r["label"] == y)
        assert 90 <= n <= 100
    assert sorted(map(str, kept)) == sorted(map(str, line_crf._whole_documents(texts.repartition(3), 100).collect()))


def test_every_term_above_the_support_is_weighed(spark):
    words = [chr(97 + i // 676) + chr(97 + i // 26 % 26) + chr(97 + i % 26) + "q" for i in range(6000)]
    docs = spark.createDataFrame([(i, " ".join(words)) for i in range(6)] + [(i, "calm and clean") for i in range(6, 60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 6)) for i in range(60)], "doc_id long, toxic int")
    lexicon = toxicity.learn(docs, labels, labelled.F.lit(True))
    assert len(lexicon.terms) == 6000 and {t.strip() for t in lexicon.terms} == set(words)
