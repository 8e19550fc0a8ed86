import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from bunkerline.operators.scoring import score


def test_failing_rows_alone_are_infinite(spark):
    rows = spark.range(0, 1000, 1, 3).withColumn("x", F.col("id").cast("double"))

    def objective(batch):
        if (batch["id"] % 97 == 13).any():
            raise RuntimeError("broken ship")
        return np.where(batch["id"] % 50 == 7, np.nan, batch["x"] * 2)

    watch = Observation()
    got = {r["id"]: r for r in score(rows, objective, watch=watch).collect()}
    assert len(got) == 1000
    for i, r in got.items():
        if i % 97 == 13:
            assert r["score"] == np.inf and r["score_error"] == "RuntimeError: broken ship"
        elif i % 50 == 7:
            assert r["score"] == np.inf and r["score_error"] == "not a number"
        else:
            assert r["score"] == 2.0 * i and r["score_error"] is None
    failures = sum(r["score_error"] is not None for r in got.values())
    assert watch.get == {"evaluations": 1000, "failures": failures}


def test_wrong_lengths_repair_and_clashes(spark):
    rows = spark.createDataFrame([(1, 5.0), (2, -5.0), (3, None)], "id int, x double")
    kept = score(rows, lambda b: b["x"] + 1, repair=lambda d: d.withColumn("x", F.abs("x"))).orderBy("id").collect()
    assert [(r["x"], r["score"]) for r in kept] == [(5.0, 6.0), (5.0, 6.0), (None, np.inf)]
    short = score(rows.coalesce(1), lambda b: [1.0] * max(len(b) - 1, 1)).collect()  # right only for a row alone
    assert [r["score"] for r in short] == [1.0] * 3
    assert score(rows.where("false"), lambda b: b["x"]).collect() == []
    with pytest.raises(ValueError):
        score(rows.withColumn("score", F.lit(1)), lambda b: b["x"])
