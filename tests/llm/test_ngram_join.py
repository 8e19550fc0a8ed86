import random
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bunkerline.llm import ngram_join as nj
from bunkerline.llm.components import components
from bunkerline.llm.queries import QUERIES


def shingles(text, width):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or ({tuple(words)} if words else set())


def brute(rows, width, num, den):
    sets = [shingles(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((str(d), len(sets[i]), str(least.get(find(i))), links[i]) for i, (d, _) in enumerate(rows))


def check(spark, rows, width, at_least, **more):
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, node string")
    out = nj.join_texts(docs, width, at_least, **more).collect()
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["links"]) for r in out)
    assert got == brute(rows, width, at_least.numerator, at_least.denominator)


def made_up(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["", "A", "é"]) + "".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 3)))
    prose = lambda n: [word() for _ in range(n)]
    texts = [prose(rng.randint(0, 60)) for _ in range(20)]
    for size, copies in ((60, 14), (150, 9), (12, 8), (400, 6)):
        base = prose(size)
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randint(0, max(1, size // 60))):
                own[rng.randrange(len(own))] = word()
            if rng.random() < 0.3:
                own = own[: -rng.randint(1, 3)]
            texts.append(own)
    passage = prose(80)
    texts += [prose(40) + passage + prose(40) for _ in range(8)] + [["the", "same"]] * 3 + [["The", "SAME"], ["a"], ["a"], []]
    rows = [(i, rng.choice([" ", "\n", "\t "]).join(t)) for i, t in enumerate(texts)]
    return rows + [(None, rows[25][1]), (None, None), (4, rows[4][1]), (4, rows[30][1]), (500, " \n")]


def test_against_brute_force(spark):
    for seed in range(2):
        check(spark, made_up(seed), 3, Fraction(9, 10))
    check(spark, made_up(5), 5, Fraction(4, 5))


def test_clusters_cut_into_blocks(spark):
    check(spark, made_up(9), 3, Fraction(9, 10), block=3)


def test_empty_table(spark):
    assert nj.join_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**32), st.integers(9, 120), st.floats(0, 1))
def test_linked_sets_share_a_key(seed, n, share):
    rng = np.random.default_rng(seed)
    pool = np.unique(rng.integers(0, 2**63, 3 * n).astype(np.uint64))
    a = np.sort(rng.choice(pool, n, replace=False))
    b = a.copy()
    for _ in range(rng.integers(0, n // 9 + 2)):
        b = np.delete(b, rng.integers(len(b))) if rng.random() < 0.5 else np.append(b, rng.choice(pool))
    b = np.unique(b)
    frequent = (rng.random(nj.CELLS // 8) < share).astype(np.uint8) * np.uint8(255)
    both = len(np.intersect1d(a, b))
    j = Fraction(9, 10)
    if len(b) >= 9 and nj._linked(both, len(a), len(b), j) and both < max(len(a), len(b)):
        (ra, pa), (rb, pb) = nj.keys(a, frequent, j), nj.keys(b, frequent, j)
        assert set(ra.tolist()) & set(rb.tolist()) or set(pa.tolist()) & set(pb.tolist())
    sign = lambda t: (len(t), len(nj.signature(t)), int.from_bytes(nj.signature(t), "little"))
    assert nj._most_shared(sign(a), sign(b)) >= both and nj._most_shared(sign(b), sign(a)) >= both


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 200), (300, 301), (301, 300), (None, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {300: 300, 301: 300}


def test_low_similarity_is_refused(spark):
    with pytest.raises(ValueError):
        nj.join_texts(spark.createDataFrame([], "doc_id long, text string"), at_least=Fraction(1, 2))


def test_whole_table(spark, small_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()]
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["links"]) for r in QUERIES["op3_ngram_join"](spark, small_dir).collect())
    want = brute(docs, 3, 9, 10)
    assert got == want and any(c != d for d, _, c, _ in want)


def test_only_wanted_ids_move(spark):
    """Every row of a wanted id stays, and few others, whatever the signs of the ids."""
    rows = spark.range(-5000, 5000).select(F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(F.xxhash64("id")).alias("_id"), F.lit("t").alias("text"))
    wanted = rows.where("_id % 10 = 0").select("_id")
    got = nj._only(rows, "_id", wanted)
    assert got.columns == ["_id", "text"]
    kept, want = [r[0] for r in got.collect()], [r[0] for r in wanted.collect()]
    assert set(want) <= set(kept) and len(kept) == len(set(kept)) <= len(want) + 50
    assert nj._only(rows, "_id", wanted.where("_id is null")).count() == 0


def test_rare_tokens_are_dealt_out_once(spark, tmp_path):
    rows = [(k, 9, b"\xff" * 8, [k // 3, 7, 8], [k]) for k in range(30)]
    spark.createDataFrame(rows, "node long, n long, bits binary, singles array<long>, pairs array<long>").write.parquet(f"{tmp_path}/index")
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    for k, v in zip(before, ("false", "-1")):
        spark.conf.set(k, v)
    try:
        plan = nj._candidates(spark.read.parquet(f"{tmp_path}/index"), Fraction(4, 5))._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    # the rows for both uses, and what is compared under a key
    assert sum("REPARTITION_BY_COL" in line and "ReusedExchange" not in line for line in plan.split("\n")) == 2
