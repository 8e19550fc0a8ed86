import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bunkerline.functions.expr import as_number, cell_kind, float_bin, piecewise_linear
from bunkerline.functions.ordering import exact_percentiles, global_rank, running_min_before, value_positions, with_neighbours
from bunkerline.operators import stats


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.normal(0, 3, 400), np.full(250, 1.25), [0.0, -0.5, 1e-300, -1e12]])
    groups = np.where(rng.random(len(values)) < 0.4, "a", "b")
    pdf = pd.DataFrame({"g": groups, "v": values, "id": np.arange(len(values))})
    return pdf, spark.createDataFrame(pdf)


def test_percentiles_match_numpy_with_a_hot_value(skewed):
    pdf, df = skewed
    got = {r["g"]: r for r in exact_percentiles(df, ["g"], "v", {"lo": 0.1, "mid": 0.5, "hi": 0.9}).collect()}
    for g, part in pdf.groupby("g"):
        want = np.quantile(part["v"], [0.1, 0.5, 0.9])
        assert got[g]["n"] == len(part)
        np.testing.assert_allclose([got[g]["lo"], got[g]["mid"], got[g]["hi"]], want, rtol=1e-12)


def test_bins_keep_the_order(skewed):
    pdf, df = skewed
    rows = df.select("v", float_bin(F.col("v")).alias("b")).orderBy("v").collect()
    assert [r["b"] for r in rows] == sorted(r["b"] for r in rows)


def test_positions_ranks_and_neighbours(skewed):
    pdf, df = skewed
    placed = {r["v"]: (r["below"], r["cnt"]) for r in value_positions(df, [], "v").collect()}
    for v, (below, cnt) in placed.items():
        assert below == (pdf["v"] < v).sum() and cnt == (pdf["v"] == v).sum()
    ordered = pdf.sort_values(["v", "id"]).reset_index(drop=True)
    ranked = global_rank(df, ["v", "id"], "rank", total="n").orderBy("rank").collect()
    assert [r["id"] for r in ranked] == list(ordered["id"]) and ranked[0]["n"] == len(pdf)
    near = {r["id"]: (r["p"], r["f"]) for r in with_neighbours(df, "v", "id", "p", "f").collect()}
    for i, row in ordered.iterrows():
        before = ordered["v"][i - 1] if i else None
        after = ordered["v"][i + 1] if i + 1 < len(ordered) else None
        assert near[row["id"]] == (before, after)


def test_running_minimum(skewed):
    pdf, df = skewed
    ordered = pdf.sort_values(["v", "id"]).reset_index(drop=True)
    want = ordered["id"].cummin().shift(1)
    got = {r["id"]: r["m"] for r in running_min_before(df, "v", "id", "id", "m").collect()}
    for i, row in ordered.iterrows():
        assert got[row["id"]] == (None if i == 0 else want[i])


def test_cells(spark):
    cells = [" 1,234.5 ", "N/A", "-", "Division by zero!", "see note", "-3e2", "nan", None, "12d", ".5", "7."]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    got = [(r["n"], r["k"]) for r in df.select(as_number("c").alias("n"), cell_kind("c").alias("k")).collect()]
    assert got == [
        (1234.5, "number"), (None, "null"), (None, "null"), (None, "error"), (None, "unparseable"), (-300.0, "number"),
        (None, "error"), (None, "null"), (None, "unparseable"), (0.5, "number"), (7.0, "number")]


def test_piecewise(spark):
    df = spark.createDataFrame([(y,) for y in (2000, 2023, 2024, 2026, 2030, 2040)], "y int")
    got = [r[0] for r in df.select(piecewise_linear(F.col("y"), {2024: 1.0, 2028: 3.0, 2030: 2.0})).collect()]
    assert got == [1.0, 1.0, 1.0, 2.0, 2.0, 2.0]


def test_wilcoxon_matches_hand_ranks(spark):
    pairs = [(3.0, 1.0), (1.0, 3.0), (5.0, 1.0), (2.0, 2.0), (9.0, 2.0)]
    row = stats.wilcoxon(spark.createDataFrame(pairs, "a double, b double"), "a", "b").first()
    assert (row["n"], row["w_plus"], row["w_minus"]) == (4, 8.5, 1.5)
    assert 0.0 < row["p_value"] < 1.0


def test_one_narrow_band_one_value_and_odd_numbers(spark):
    """Values in one narrow range, one repeated value, null, NaN and infinity keep Spark's order and lose no row."""
    rows = [(i, 1000.0 + i / 1e6) for i in range(300)] + [(300 + i, 7.0) for i in range(300)]
    rows += [(600, None), (601, float("nan")), (602, float("inf")), (603, float("-inf")), (604, -0.0)]
    df = spark.createDataFrame(rows, "id long, v double")
    key = lambda r: (r[1] is not None, r[1] != r[1] if r[1] is not None else False, 0.0 if r[1] is None or r[1] != r[1] else r[1], r[0])
    ordered = sorted(rows, key=key)
    ranked = global_rank(df, ["v", "id"], "rank").orderBy("rank").collect()
    assert [r["id"] for r in ranked] == [r[0] for r in ordered]
    near = {r["id"]: (r["p"], r["f"]) for r in with_neighbours(df, "v", "id", "p", "f").collect()}
    assert len(near) == len(rows)
    same = lambda a, b: a == b or (a != a and b != b)
    for before, (i, _), after in zip(ordered, ordered[1:], ordered[2:]):
        assert same(near[i][0], before[1]) and same(near[i][1], after[1])
    low = {r["id"]: r["m"] for r in running_min_before(df, "v", "id", "id", "m").collect()}
    least = None
    for i, _ in ordered:
        assert low[i] == least
        least = i if least is None else min(least, i)
    placed = {r["v"]: (r["below"], r["cnt"]) for r in value_positions(df, [], "v").collect()}
    assert placed[7.0] == (2, 300) and placed[float("inf")][0] == 602
