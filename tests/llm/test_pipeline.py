"""Each stage of the pipeline against a brute-force version on its own input."""

import hashlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as cp
from bunkerline.llm import line_crf, mixing
from bunkerline.llm.labelled import probability
from bunkerline.llm.queries import quality_model
from test_ngram_join import brute as near_groups
from test_packing import check_packed, whole_ids
from test_suffix_dedup import brute as repeated


@pytest.fixture(scope="module")
def stages(spark, small_dir, tmp_path_factory):
    """The rows before each stage, and the result."""
    folder = tmp_path_factory.mktemp("stages")
    df = spark.read.parquet(f"{small_dir}/documents.parquet")
    rows = [df.collect()]
    for k, (_, stage) in enumerate(cp.STAGES):
        out = stage(spark, df, small_dir)
        if k + 1 < len(cp.STAGES):
            assert out.columns == cp.COLUMNS
        out.write.parquet(f"{folder}/{k}")
        df = spark.read.parquet(f"{folder}/{k}")
        rows.append(df.collect())
    return rows


def ids(rows):
    return sorted(r["doc_id"] for r in rows)


def test_names():
    assert len(cp.STAGES) == 5 and cp.ORACLE_SQL is None


def test_classifier(spark, stages, small_dir):
    model = quality_model(spark, spark.read.parquet(f"{small_dir}/documents.parquet"), small_dir)
    stays = []
    for r in stages[0]:
        f, n = line_crf.document_lines((r["text"] or "").encode())
        bad, _ = line_crf.Chains(np.array([len(n)])).marginals(f @ model.weights, model.steps)
        if probability(line_crf.quality(bad, n, np.array([0])), model.curve)[0] >= cp.LEAST_QUALITY:
            stays.append(r["doc_id"])
    assert ids(stages[1]) == sorted(stays)
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{small_dir}/labels.parquet").collect()}
    good = [d for d in ids(stages[0]) if quality.get(d) == 1]
    assert np.mean([d in set(stays) for d in good]) > 0.97


def test_near_copies(stages):
    groups = near_groups([(r["doc_id"], r["text"]) for r in stages[1]], 5, 4, 5)
    assert [str(d) for d in ids(stages[2])] == sorted((c for d, _, c, _ in groups if d == c), key=int)


def exchanges(plan):
    """The columns of every shuffle that a plan starts out with."""
    plan = plan.initialPlan() if hasattr(plan, "initialPlan") and plan.nodeName() == "AdaptiveSparkPlan" else plan
    names = [plan.output().apply(i).name() for i in range(plan.output().size())]
    own = [names] if plan.nodeName() == "Exchange" else []
    return own + [e for i in range(plan.children().size()) for e in exchanges(plan.children().apply(i))]


def test_near_copies_move_texts_once(spark, small_dir):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = cp.join_near(spark, spark.read.parquet(f"{small_dir}/documents.parquet"), small_dir)
        assert sum("text" in names for names in exchanges(out._jdf.queryExecution().executedPlan())) == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_near_copies_of_repeated_rows_and_ids(spark, tmp_path):
    """Rows that repeat entirely stay once, rows of one id with other texts or columns all stay, rows without an id too."""
    text, other = " ".join(f"w{k}" for k in range(40)), " ".join(f"v{k}" for k in range(40))
    rows = [(5, text, "en", None, 1), (5, text, "en", None, 1), (5, text, "de", None, 1), (5, other, "en", "s", None), (5, other, "en", "s", None), (9, text, "en", None, 1), (None, text, "en", None, 1), (None, text, "en", None, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/rows")
    got = cp.join_near(spark, spark.read.parquet(f"{tmp_path}/rows"), "")
    own = cp.ngram_join.join_texts(spark.read.parquet(f"{tmp_path}/rows"), 5, cp.Fraction(4, 5)).where("component_id = doc_id").select("doc_id").distinct().collect()
    want = Counter(dict.fromkeys([r for r in set(rows) if r[0] in {d[0] for d in own}], 1)) + Counter(r for r in rows if r[0] is None)
    assert Counter(tuple(r) for r in got.collect()) == want and len(want) >= 3


def test_repeats(stages):
    texts = [r["text"].encode() for r in stages[2]]
    got = {r["doc_id"]: r for r in stages[3]}
    assert len(got) == len(texts)
    for r, t, mask in zip(stages[2], texts, repeated(texts, 400)):
        cut = [k for k in np.flatnonzero(mask)]
        whole = t.decode()
        kept, at = [], 0
        for c in whole:
            n = len(c.encode())
            if not mask[at : at + n].all():
                kept.append(c)
            at += n
        assert got[r["doc_id"]]["text"] == "".join(kept) and got[r["doc_id"]]["n_chars"] == (len(kept) if cut else r["n_chars"])


def test_mixture(stages):
    """Counts near the targets, each document taken not at all, once or twice, in the seeded order."""
    sizes = {r["doc_id"]: len((r["text"] or "").encode().split()) for r in stages[3]}
    source = {r["doc_id"]: r["source"] for r in stages[3]}
    copies = Counter(ids(stages[4]))
    assert set(copies.values()) <= {1, 2}
    totals = Counter()
    for d, s in source.items():
        totals[s] += sizes[d]
    goals = mixing.targets(list(totals.items()))
    for s in totals:
        own = [d for d in source if source[d] == s and sizes[d]]
        taken = sum(copies[d] * sizes[d] for d in own)
        assert taken <= goals[s] and (goals[s] - taken < max(sizes[d] for d in own))
        order = sorted(own, key=lambda d: hashlib.md5(f"mix|{d}".encode()).hexdigest())
        first, quota = 0, min(totals[s], int(goals[s]))
        for d in order:
            first += sizes[d]
            if first <= quota:
                assert copies[d] >= 1
            else:
                break


def test_packing(stages):
    rows = stages[5]
    check_packed(rows, 2048)
    want = Counter()
    for r, tokens in zip(stages[4], whole_ids([r["text"] or "" for r in stages[4]])):
        n = len(tokens) + 1
        for k, at in enumerate(range(0, n, 2048)):
            want[r["doc_id"], k, at, min(2048, n - at)] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"]) for r in rows) == want


def test_odd_rows(spark, small_dir, tmp_path):
    rows = [(1, None, "en", None, 0), (1, None, "en", None, 0), (None, "a b c d e f", None, "s", None), (2, "", "en", "s", 0), (3, "word " * 3000, "en", "s", 15000), (3, "word " * 3000, "en", "s", 15000), (4, "w " * 400 + "x", "en", "s", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for own in (rows, []):
        df = spark.createDataFrame(own, schema)
        for k, (_, stage) in enumerate(cp.STAGES[1:]):
            out = stage(spark, df, small_dir)
            path = f"{tmp_path}/{len(own)}-{k}"
            out.write.parquet(path)
            df = spark.read.parquet(path)
            if k == 0 and own:
                assert Counter(r["doc_id"] for r in df.collect()) == Counter([1, None, 2, 3, 4])
        assert (df.count() > 0) == bool(own)
