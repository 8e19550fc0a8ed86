import inspect
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from bunkerline.operators import boosting, features, learning
from bunkerline.plans import catalog  # noqa: F401
from bunkerline.plans.registry import QUERIES, Inputs

CLASSES = tuple(c[len("class_"):] for c in features.class_columns())


def made_bins(rng, n=400):
    """Three numeric inputs, one of few values, with missing ones, and a class."""
    bins = boosting.Bins(("a", "b", "few"), (tuple(np.arange(1.0, 20.0)), tuple(np.arange(1.0, 12.0)), (0.0, 1.0)), "kind", ("x", "y", "z"))
    codes = np.stack([rng.integers(0, s, n) for s in bins.sizes]).astype(np.uint8)
    return bins, codes


def brute_gain(codes, bins, gradient, input_, cut, missing_left, one, l2, least):
    code = codes[input_]
    missing = len(bins.edges[input_]) + 1 if not one else -1
    left = code != cut if one else np.where(code == missing, bool(missing_left), code <= cut)
    if min(left.sum(), (~left).sum()) < max(least, 1):
        return 0.0
    loss = lambda rows: gradient[rows].sum() ** 2 / (rows.sum() + l2)
    return loss(left) + loss(~left) - loss(np.ones(len(left), bool))


@pytest.mark.parametrize("l2, least", [(0.0, 1), (1.0, 1), (5.0, 25)])
def test_split_gains_equal_brute_force(l2, least):
    rng = np.random.default_rng(3)
    bins, codes = made_bins(rng)
    gradient = rng.normal(size=codes.shape[1]) + (codes[0] > 9) - 0.5 * (codes[-1] == 1)
    g, n = boosting.histogram(codes + bins.offsets[:-1, None], gradient, np.zeros(codes.shape[1], np.int64), 1, bins.offsets[-1])
    settings = boosting.Settings(l2=l2, min_rows=least)
    wide = np.full(1, np.inf)
    best = boosting.best_splits(g, n, bins, settings, np.ones(6, bool), -wide, wide)
    candidates = bins.splits()
    gains = [brute_gain(codes, bins, gradient, i, c, m, o, l2, least) for i, c, m, o in zip(*(candidates[k].tolist() for k in ("input", "cut", "missing_left", "one")))]
    assert best["gain"][0] == pytest.approx(max(gains))
    only = [i for i, (f, o) in enumerate(zip(candidates["input"], candidates["one"])) if f == 1 and not o]
    best = boosting.best_splits(g, n, bins, settings, np.array([0, 1, 0, 0, 0, 0], bool), -wide, wide)
    assert best["gain"][0] == pytest.approx(max(0, max(gains[i] for i in only)))


def test_monotone_input_never_rises_and_missing_values_choose_a_side():
    rng = np.random.default_rng(5)
    bins, codes = made_bins(rng, 3000)
    missing = codes[0] == 20
    label = np.where(missing, 2.0, -np.sin(codes[0] / 3.0)) + 0.3 * codes[1] * (codes[-1] == 2) + rng.normal(size=codes.shape[1])
    plain, bound = (boosting.Model(bins, *boosting.fit_local(codes, label, bins, boosting.Settings(trees=60, rate=0.2, monotone=m))) for m in ({}, {"a": -1}))
    grid = np.repeat(codes[:, :200], 20, axis=1)
    grid[0] = np.tile(np.arange(20), 200)
    steps = lambda model: np.diff(model.score(grid).reshape(200, 20), axis=1)
    assert (steps(plain) > 0.1).any() and (steps(bound) <= 0).all() and (steps(bound) < -0.1).any()
    assert bound.score(codes)[missing].mean() == pytest.approx(label[missing].mean(), abs=0.15)
    rising = boosting.Model(bins, *boosting.fit_local(codes, label, bins, boosting.Settings(trees=30, rate=0.2, monotone={"a": 1})))
    assert (steps(rising) >= 0).all()


def test_l2_and_least_rows_hold_leaves_back():
    rng = np.random.default_rng(6)
    bins, codes = made_bins(rng)
    label = rng.normal(size=codes.shape[1])
    spread = [np.std(boosting.Model(bins, *boosting.fit_local(codes, label, bins, boosting.Settings(trees=5, l2=l2))).score(codes)) for l2 in (0.0, 10.0, 1000.0)]
    assert spread[0] > spread[1] > spread[2]
    _, trees = boosting.fit_local(codes, label, bins, boosting.Settings(trees=5, min_rows=40, subsample=1.0))
    leaves = [t.rows[i] for t in trees for i in np.flatnonzero(t.input >= 0)]
    assert min(leaves) >= 80
    assert boosting.fit_local(codes[:, :0], label[:0], bins, boosting.Settings(trees=2))[0] == 0.0
    with pytest.raises(ValueError):
        boosting.Settings(rate=0)


def planted(spark, n=4000):
    """Ship-years whose level falls with design efficiency's inverse, rises in one class, and is high without a certificate."""
    rng = np.random.default_rng(11)
    rows = []
    for i in range(n):
        design = None if rng.random() < 0.2 else float(rng.uniform(1, 50))
        cls = CLASSES[int(rng.integers(len(CLASSES)))]
        level = (6.0 if design is None else 7 - 0.03 * design) + 0.4 * (cls == CLASSES[2]) + rng.normal() * 0.05
        rows.append((i // 4, cls, design, int(design is not None), 0, 1, 0, 0, 0.0, 0.0, 2018.0 + i % 4, None if i % 9 == 0 else float(rng.uniform(1000, 6000)), math.exp(level) if i % 50 else None))
    return spark.createDataFrame(rows, "imo long, vessel_class string, " + ", ".join(f"{c} double" if c not in ("has_design_efficiency", "efficiency_metric_eiv", "efficiency_metric_eedi", "efficiency_metric_eexi", "has_ice_class") else f"{c} int" for c in learning.NUMERIC) + ", target double")


def mape(scored):
    return scored.where("target is not null").agg((F.avg(F.abs(F.exp("log_level") / F.col("target") - 1)) * 100)).first()[0]


def test_planted_signal_beats_class_means(spark):
    df = planted(spark).withColumn("fold", (F.col("imo") % 3).cast("int")).persist()
    train, test = df.where("fold > 0"), df.where("fold = 0")
    trees, flat = mape(learning.fit_trees(train, trees=80, rate=0.1, monotone=True)(test)), mape(learning.fit_class_mean(train)(test))
    assert trees < 6 and flat > 2.5 * trees
    out = learning.out_of_fold_trees(df, 3, boosting.Settings(trees=40, rate=0.15)).collect()
    assert len(out) == df.where("target > 0").count() and all(abs(r["residual"]) < 2 for r in out)
    one = learning.fit_tree_models(df, {"m": (boosting.Settings(trees=40, rate=0.15), F.col("fold") != 1)})
    want = {r["imo"]: r["log_level"] for r in boosting.score(df.where("fold = 1 and reporting_period = 2018"), one, F.lit("m")).collect()}
    got = {r["imo"]: r["log_level"] for r in out if r["fold"] == 1 and r["reporting_period"] == 2018}
    assert got == {k: want[k] for k in got}  # rows are scored by the model that did not see their fold
    assert boosting.score(df.limit(3), one, F.lit("none")).where("log_level is null").count() == 3


def test_rows_spread_over_blocks_give_the_same_model(spark):
    df = planted(spark, 1500).where("target is not null").repartition(3)
    bins = learning.tree_bins(df, 40)
    settings = boosting.Settings(trees=10, depth=4, rate=0.3, subsample=1.0, monotone=learning.DECREASING)
    spread = boosting.fit_spread(df, F.ln("target"), bins, settings, block_rows=200)
    codes, label, _ = boosting.sample(df, F.col("imo"), F.ln("target"), F.lit(1), bins)
    local = boosting.Model(bins, *boosting.fit_local(codes, label, bins, settings))
    assert len(label) == df.count() and spread.base == pytest.approx(local.base)
    assert np.allclose(spread.score(codes), local.score(codes), atol=1e-9)
    drawn = boosting.fit_spread(df, F.ln("target"), bins, boosting.Settings(trees=10, depth=4, rate=0.3), block_rows=200)
    again = boosting.fit_spread(df, F.ln("target"), bins, boosting.Settings(trees=10, depth=4, rate=0.3), block_rows=200)
    assert (drawn.score(codes) == again.score(codes)).all() and np.std(drawn.score(codes) - label) < 0.2
    assert boosting.fit_spread(df.limit(0), F.ln("target"), bins, settings).trees == []


def test_models_as_rows_and_bounded_samples(spark):
    df = planted(spark, 1200)
    bins = learning.tree_bins(df)
    codes, label, uses = boosting.sample(df, F.col("imo"), F.ln("target"), F.lit(1), bins)
    nodes = boosting.fit_many(spark, codes, label, uses, bins, {"m": (boosting.Settings(trees=7), 0)})
    base, trees = boosting.fit_local(codes, label, bins, boosting.Settings(trees=7))
    assert (boosting.models_of(nodes, bins)["m"].score(codes) == boosting.Model(bins, base, trees).score(codes)).all()
    assert nodes.where("input is null and value is null").count() == 0 and nodes.where("gain <= 0").count() == 0
    few, _, ships = boosting.sample(df, F.col("imo"), F.ln("target"), F.col("imo"), bins, most=200)
    assert 100 < few.shape[1] <= 200
    per_ship = {r["imo"]: r["n"] for r in df.where("target is not null").groupBy("imo").agg(F.count("*").alias("n")).collect()}
    assert all((ships == s).sum() == per_ship[s] for s in set(ships.tolist()))


def test_trials_keep_what_went_wrong(spark):
    df = planted(spark, 800).withColumn("fold", (F.col("imo") % 3).cast("int"))
    candidates = {"good": {"trees": 20, "rate": 0.3}, "refused": {"rate": 0.0}, "unknown": {"leaves": 3}, "wild": {"trees": 3, "l2": math.nan}}
    rows = learning.tune(df, candidates).collect()
    assert len(rows) == 12
    errors = {r["candidate"]: (r["mape"], r["error"]) for r in rows}
    assert errors["good"][1] is None and 0 < errors["good"][0] < 30
    assert all(errors[c][0] == math.inf and errors[c][1] for c in ("refused", "unknown"))
    table = learning.search_arms(df, n=3, most=500)
    arms = {r["arm"]: r for r in learning.arm_summary(table).collect()}
    assert set(arms) == {"default", "halving", "random"} and all(r["mape"] > 0 for r in arms.values())
    assert arms["halving"]["candidates"] == 3 and arms["random"]["trees_grown"] >= arms["halving"]["trees_grown"] - 3
    rungs = {(r["rung"], r["candidates"]) for r in table.where("arm = 'halving'").groupBy("rung").agg(F.countDistinct("candidate").alias("candidates")).collect()}
    assert rungs == {(0, 3), (1, 1)}


def test_draws_cover_the_whole_space():
    drawn = learning.sample_space(200, 1000)
    assert all(set(p) == set(learning.SPACE) for p in drawn)
    for name, (low, high, _) in learning.SPACE.items():
        values = [p[name] for p in drawn]
        assert low <= min(values) < low + 0.1 * (high - low) and high - 0.1 * (high - low) < max(values) <= high


@pytest.mark.parametrize("name", ["mdl_gbt", "mdl_monotone", "mdl_oof_residuals", "mdl_oof_coverage"])
def test_registered_fits(spark, small_dir, name):
    rows = QUERIES[name](Inputs(spark, small_dir)).collect()
    if name == "mdl_oof_residuals":
        assert {"global", "cold"} <= {r["scope"] for r in rows} and all(r["low"] < 0 < r["high"] for r in rows)
    elif name == "mdl_oof_coverage":
        assert rows[0]["rows"] == rows[0]["scored"] > 0 and rows[0]["shared_ships"] == 0 and rows[0]["folds"] == 5
    else:
        assert rows[0]["n"] > 0 and 0 < rows[0]["mape"] < 200


def test_population_search_takes_the_whole_fleet_and_the_defaults(spark, small_dir, monkeypatch):
    from bunkerline.operators.fleet import COASTAL
    from bunkerline.plans import fitting

    asked = {}
    real = inspect.signature(fitting.search.search)

    def stand_in(*args, **params):
        bound = real.bind(*args, **params)
        bound.apply_defaults()
        asked.update(bound.arguments)
        return bound.arguments["vessels"].limit(1), []

    monkeypatch.setattr(fitting.search, "search", stand_in)
    t = Inputs(spark, small_dir)
    QUERIES["flt_population_search"](t)
    assert asked["vessels"].count() == fitting.vessels(t).count()
    assert asked["scenario"] == COASTAL and (asked["individuals"], asked["generations"]) == (20, 60)


def test_models_of_more_rows_than_a_task_holds_use_all_of_them(spark, monkeypatch):
    """Spread over blocks, each with its own draws of rows and rows to see, models are those of a task that holds all rows."""
    df = planted(spark, 2400).withColumn("fold", (F.col("imo") % 3).cast("int")).repartition(3).persist()
    settings = boosting.Settings(trees=8, depth=4, rate=0.3, columns=0.5, monotone=learning.DECREASING)
    models = {"a": (settings, F.col("fold") != 0), "b": (boosting.with_settings(settings, trees=5, depth=3, subsample=0.6), F.col("fold") != 1)}
    monkeypatch.setattr(boosting, "KEPT_TREES", 3)
    monkeypatch.setattr(boosting, "RECORD_NODES", 3)
    held, spread = learning.fit_tree_models(df, models), learning.fit_tree_models(df, models, most=500)
    monkeypatch.setattr(boosting, "SENT_BYTES", 0)
    added = learning.fit_tree_models(df, models, most=500)
    fold_rows = {"a": df.where("target > 0 and fold != 0").count(), "b": df.where("target > 0 and fold != 1").count()}
    codes, _, _ = boosting.sample(df.where("target > 0"), F.col("imo"), F.ln("target"), F.lit(1), held["a"].bins)
    for name in models:
        assert len(spread[name].trees) == len(held[name].trees) == len(added[name].trees)
        root = np.array([t.rows[0] for t in spread[name].trees])
        assert np.allclose(root / fold_rows[name], models[name][0].subsample, atol=0.06)
        assert spread[name].base == pytest.approx(held[name].base)
        for other in (held, added):
            assert np.mean(np.abs(spread[name].score(codes) - other[name].score(codes)) > 1e-9) < 0.02  # ties of splits may fall otherwise


def test_search_on_more_rows_than_a_task_holds_uses_all_of_them(spark):
    df = planted(spark, 1200).withColumn("fold", (F.col("imo") % 3).cast("int")).persist()
    candidates = {"good": {"trees": 6, "rate": 0.3, "depth": 3}, "refused": {"rate": 0.0}, "short": {"trees": 2, "rate": 0.5, "depth": 2.0}}
    held, spread = ({(r["candidate"], r["fold"]): r for r in learning.tune(df, candidates, **rows).collect()} for rows in ({}, {"held": 400}))
    assert set(held) == set(spread) and len(spread) == 9
    for key, r in spread.items():
        assert (r["trees"], r["error"] is None) == (held[key]["trees"], held[key]["error"] is None) == ((6, True) if key[0] == "good" else (0, False))
        assert r["mape"] == pytest.approx(held[key]["mape"], rel=1e-3)
    trials = learning.Trials(df, 3)
    assert len(trials.data.value[1]) == df.where("target > 0").count()
