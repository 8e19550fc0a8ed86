"""Bounded samples of labelled documents, and a one-feature logistic calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, of: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(of))


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, usable: Column) -> DataFrame:
    """(text, label) of at most `per_class` labelled documents of each class, chosen by a hash of their id.

    Only labels for which `usable` holds are looked at. The join broadcasts no more than twice `per_class` ids.
    """
    known = labels.where(usable & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("label")).dropDuplicates(["doc_id"])
    order = F.xxhash64("doc_id", F.lit(label))
    chosen = [known.where(F.col("label") == k).orderBy(order).limit(per_class) for k in (0, 1)]
    return docs.select("doc_id", "text").join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id").select("text", "label")


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and intercept of a logistic curve, fitted by Newton steps."""
    if not len(x) or y.min() == y.max():
        return 1.0, 0.0 if not len(x) else (2.0 if y[0] else -2.0)
    scale = float(x.std()) or 1.0
    design = np.stack([x / scale, np.ones(len(x))], axis=1)
    w = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (y - p) / len(y) - ridge * w * [1, 0]
        hessian = (design * (p * (1 - p))[:, None]).T @ design / len(y) + np.diag([ridge, 1e-9])
        step = np.linalg.solve(hessian, gradient)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def probability(x: np.ndarray, curve: tuple[float, float]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(curve[0] * x + curve[1], -30, 30)))
