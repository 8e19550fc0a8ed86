import math

import numpy as np
import pytest

from bunkerline.llm import whitening
from bunkerline.llm.queries import QUERIES


def brute(vectors, components=32):
    x = np.array(vectors, dtype=np.int64)
    n, d = x.shape
    s = x.sum(axis=0)
    c = (n * x - s) / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1][:components], v[:, ::-1][:, :components]
    deviation = [sum((n * int(a) - int(t)) ** 2 for a, t in zip(row, s)) for row in x]
    return n, deviation, c @ v / np.sqrt(e), e / (c**2).sum() * n


def longs(embeddings):
    kept = [(i, e) for i, e in embeddings if e is not None and all(v is not None and math.isfinite(v) for v in e)]
    return [i for i, _ in kept], [[math.floor(64 * float(v)) + 1000000 for v in e] for _, e in kept]


@pytest.mark.parametrize("name", ["embeddings"])
def test_whole_table(spark, small_dir, name):
    rows = spark.read.parquet(f"{small_dir}/{name}.parquet").collect()
    ids, x = longs([(r["vec_id"], r["embedding"]) for r in rows])
    n, deviation, whitened, explained = brute(x)
    got = QUERIES["op13_whiten"](spark, small_dir).toPandas()
    assert dict(got.dtypes.astype(str)) == {"vec_id": "int64", "component": "int32", "n": "int64", "deviation": "int64", "whitened": "float64", "explained": "float64", "identity_error": "float64"}
    assert len(got) == n * 32 and (got.n == n).all() and got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    assert got.groupby("vec_id").deviation.first().to_dict() == dict(zip(ids, deviation))
    table = got.pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
    sign = np.sign((table * whitened).sum(axis=0))
    assert np.abs(table * sign - whitened).max() < 1e-8
    assert np.allclose(got.groupby("component").explained.first().to_numpy(), explained, rtol=1e-12)


@pytest.mark.parametrize("dims, wanted, kind", [(5, 32, "full"), (300, 6, "full"), (200, 12, "low"), (120, 4, "close")])
def test_eigenpairs(dims, wanted, kind):
    rng = np.random.default_rng(dims)
    q = np.linalg.qr(rng.standard_normal((dims, dims)))[0]
    e = {"full": np.sort(rng.exponential(size=dims))[::-1], "low": np.where(np.arange(dims) < 20, 1.5 ** -np.arange(dims, dtype=float), 0), "close": 1 + 1e-6 * rng.random(dims)}[kind]
    e = np.sort(e)[::-1]
    a = (q * e) @ q.T
    asked = []

    def multiply(columns):
        asked.append(columns.shape)
        return a @ columns

    values, vectors = whitening.eigenpairs(multiply, dims, wanted)
    assert np.allclose(values, e[:wanted], rtol=0, atol=1e-12 * e[0])
    assert np.linalg.norm(a @ vectors - vectors * values, axis=0).max() < 1e-12 * e[0]
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12
    assert all(shape[0] == dims and shape[1] <= wanted + whitening.GUARD for shape in asked)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0], "a"), (None, [3.0, -1.0], "b"), (None, [3.0, -1.0], "b"), (2, None, "c"), (3, [nan, 0.0], "d"), (4, [None, 0.0], "e"), (5, [inf, 0.0], "f"), (6, [0.5], "g"), (7, [], "h"), (8, [-2.25, 9.0], "i")]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>, x string")
    table = whitening.valid(docs, "embedding").selectExpr("vec_id", "x as n", "transform(embedding, v -> floor(64 * cast(v as double)) + 1000000) as x")
    got = whitening.whiten(table, "x", keep=("vec_id", "n")).toDF("vec_id", "label", "component", "n", "deviation", "whitened", "explained", "identity_error").collect()
    ids, x = longs([(r[0], r[1]) for r in rows if r[1] and len(r[1]) == 2])
    n, deviation, _, explained = brute(x)
    assert n == 4 and len(got) == 8
    assert sorted((r["vec_id"] or 0, int(r["deviation"])) for r in got if r["component"] == 1) == sorted((i or 0, d) for i, d in zip(ids, deviation))
    assert {round(r["explained"], 12) for r in got} == {round(float(v), 12) for v in explained}
    empty = whitening.whiten(table.limit(0), "x", keep=("vec_id",))
    assert empty.count() == 0 and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    same = whitening.whiten(table.where("vec_id is null"), "x", keep=("vec_id",)).collect()
    assert len(same) == 4 and all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None and r["deviation"] == 0 for r in same)


def test_deviation_beyond_a_long():
    d = np.array([[1 << 40, -(1 << 40)], [1, 2]], np.int64)
    assert [int(v.as_py()) for v in whitening._deviations(d)] == [1 << 81, 5]
