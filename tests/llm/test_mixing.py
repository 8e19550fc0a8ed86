import pytest
from pyspark.sql import functions as F

from bunkerline.llm import mixing
from bunkerline.llm.queries import ORACLES, QUERIES
from compare import compare, connect


def test_query_agrees_with_sql(spark, small_dir):
    status, note, rows = compare(QUERIES["op6_mix"](spark, small_dir), connect(small_dir), ORACLES["op6_mix"])
    assert status == "OK" and rows, note


def test_each_source_comes_near_its_target(spark, small_dir):
    rows = QUERIES["op6_mix"](spark, small_dir.replace("sf0.001", "sf0.01")).groupBy("source_size", "target").agg(F.sum("taken").alias("t"), F.max(F.col("taken") - 2 * F.col("size")).alias("over")).collect()
    for r in rows:
        assert r["over"] <= 0 and abs(r["t"] - r["target"]) <= max(20, 0.03 * r["target"]), r


def test_targets_stop_at_the_cap_and_reshare():
    got = mixing.targets([("b", 100), ("a", 1000), (None, 10)])  # weights a 3, b 1, null 2
    assert got[None] == 20 and got["b"] == 200 and got["a"] == pytest.approx(1.5 * 1110 - 220)
    assert mixing.targets([]) == {} and mixing.targets([("a", 0)]) == {"a": 0}


def brute_flow_cost(patterns, quotas):
    """The cheapest way to place the largest number of words, by trying every split of unit words."""
    units = [(i, names) for i, (names, size) in enumerate(patterns) for _ in range(size)]
    states = {(tuple(quotas[s] for s in quotas)): (0, 0)}
    keys = list(quotas)
    for _, names in units:
        new = {}
        options = [()] + [(s,) for s in names] + [(s, z) for s in names for z in names]
        for left, (flow, cost) in states.items():
            for o in options:
                l = list(left)
                for s in o:
                    l[keys.index(s)] -= 1
                if min(l) < 0:
                    continue
                cand = (flow + len(o), cost - (len(o) == 2))
                k = tuple(l)
                if k not in new or cand > new[k]:
                    new[k] = cand
        states = new
    return max(states.values())


@pytest.mark.parametrize("patterns, quotas", [
    ([(("a",), 3), (("a", "b"), 2), (("b",), 1)], {"a": 6, "b": 3}),
    ([(("a", "b", "c"), 4), (("c",), 2)], {"a": 3, "b": 3, "c": 5}),
    ([(("a",), 0), (("b",), 2)], {"a": 1, "b": 9}),
])
def test_flow_is_largest_and_cheapest(patterns, quotas):
    dealt = mixing.flow(patterns, quotas)
    second = sum(n for (_, copy, _), n in dealt.items() if copy == 1)
    assert (sum(dealt.values()), -second) == brute_flow_cost(patterns, quotas)


def test_overlapping_and_odd_rows(spark):
    rows = [(i, ["a", "b"][: 1 + i % 2], 5 + i % 7, "x") for i in range(300)] + [(None, None, 3, "x"), (5, [], 3, "x"), (1, ["b", "a", "a"], 0, "x"), (7, [None], 4, "x"), (7, [None], 4, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, names array<string>, n long, takes string")
    out = mixing.mix(docs, F.col("n"), F.col("names"), {"a": 1500, "b": 900, None: 6}).collect()
    assert len(out) == len(rows)
    got = {}
    for r in out:
        assert set(r["takes"]) <= set(r["names"] or []) and len(r["takes"]) <= 2 and r["taken"] == len(r["takes"]) * r["n"]
        for s in r["takes"]:
            got[s] = got.get(s, 0) + r["n"]
    assert abs(got["a"] - 1500) <= 16 and abs(got["b"] - 900) <= 16 and got[None] == 4
    assert mixing.mix(docs.limit(0), F.col("n"), F.col("names"), {}).count() == 0


def missing_and_unused(out, quotas, repeats=2):
    """For each source: words it lacks, and the sizes of its documents that were never taken, or once in a copy that is not full."""
    lack = {s: int(q) - sum(r["size"] * r["takes"].count(s) for r in out) for s, q in quotas.items()}
    whole = {s: q >= sum(r["size"] for r in out if s in r["names"]) for s, q in quotas.items()}
    spare = {s: [r["size"] for r in out if s in r["names"] and r["size"] and len(r["takes"]) < (repeats if whole[s] else 1)] for s in quotas}
    return lack, spare


@pytest.mark.parametrize("seed", ["mix", "b", "c"])
def test_a_long_text_leaves_no_gap_that_unused_short_ones_fill(spark, seed):
    docs = spark.range(2001).select(F.col("id").alias("doc_id"), F.array(F.lit("a")).alias("names"), F.when(F.col("id") == 0, 200_000).otherwise(100 + F.col("id") % 3).alias("n"))
    size = docs.agg(F.sum("n")).first()[0]
    quotas = {"a": 1.5 * size}
    lack, spare = missing_and_unused(mixing.mix(docs, F.col("n"), F.col("names"), quotas, seed=seed).collect(), quotas)
    assert 0 <= lack["a"] < min(spare["a"], default=1), lack


def test_no_unused_document_of_overlapping_sources_fits(spark):
    rows = [(i, [["a"], ["b"], ["a", "b"], [None, "b"]][i % 4], 5000 if i % 97 == 0 else 10 + i % 7) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, names array<string>, n long")
    quotas = {"a": 9000, "b": 6000, None: 1500}
    out = mixing.mix(docs, F.col("n"), F.col("names"), quotas, seed="x").collect()
    lack, spare = missing_and_unused(out, quotas)
    assert all(set(r["takes"]) <= set(r["names"]) and len(r["takes"]) <= 2 for r in out)
    for s in quotas:
        assert 0 <= lack[s] < min((n for n in spare[s]), default=10**9), (s, lack)


def test_columns_named_like_those_of_the_plan(spark):
    rows = [(i, "s", 10 + i % 5, i, str(i), i % 2 == 0, i, i) for i in range(60)]
    spec = "doc_id long, source string, n long, more long, open string, most boolean, seg long, `a.b` long"
    docs = spark.createDataFrame(rows, spec)
    out = mixing.mix(docs, F.col("n"), F.array("source"), {"s": 900}).collect()
    plain = mixing.mix(docs.select("doc_id", "source", "n"), F.col("n"), F.array("source"), {"s": 900}).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in out) == sorted((r["doc_id"], r["taken"]) for r in plain)
    assert {(r["doc_id"], r["more"], r["open"], r["most"], r["seg"], r["a.b"]) for r in out} == {(r[0], r[3], r[4], r[5], r[6], r[7]) for r in rows}
    other = docs.select("doc_id", "source", "n", F.lit(1).alias("key"), F.lit(2).alias("copy"), F.lit(3).alias("to"), F.lit(4).alias("run"), F.lit(5).alias("lacks"))
    assert mixing.mix(other, F.col("n"), F.array("source"), {"s": 900}).agg(F.sum("taken"), F.sum("key"), F.sum("lacks")).first()[1:] == (60, 300)
