"""Scoring candidate rows by a user's own vectorised function.

The built-in objectives of ``fleet`` are column expressions. Where an objective is only to be had as Python, ``score`` runs it
over Arrow batches in the tasks that hold the candidates: nothing is gathered, and a lost executor only repeats its batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

Objective = Callable[[pd.DataFrame], "pd.Series | np.ndarray | list[float]"]
MOST_TEXT = 500  # characters kept of an error


def _attempt(objective: Objective, rows: pd.DataFrame, scores: np.ndarray, errors: np.ndarray, places: np.ndarray) -> None:
    """Score the rows at ``places``; a failure is traced to its rows by halving, the others keep their scores."""
    waiting = [places]
    while waiting:
        at = waiting.pop()
        try:
            got = np.asarray(objective(rows.iloc[at]), dtype="float64")
            if got.shape != (len(at),):
                raise ValueError(f"{got.size} scores for {len(at)} candidates")
        except Exception as failed:  # the user's code may raise anything
            if len(at) > 1:
                waiting += [at[: len(at) // 2], at[len(at) // 2:]]
                continue
            errors[at] = f"{type(failed).__name__}: {failed}"[:MOST_TEXT]
            continue
        scores[at] = got
    # a score is a number, or plus infinity for a candidate that has none
    odd = np.isnan(scores)
    scores[odd] = np.inf
    errors[odd & (errors == None)] = "not a number"  # noqa: E711  (element by element)


def score(
    candidates: DataFrame, objective: Objective, repair: Callable[[DataFrame], DataFrame] | None = None,
    watch: Observation | None = None, name: str = "score",
) -> DataFrame:
    """All columns of the candidates, ``name`` (lower is better) and ``{name}_error``.

    ``objective`` gets a batch as a pandas frame and returns one number a row. If it raises, returns too few or too many
    numbers, or a number that is NaN, the rows at fault score plus infinity with the error's text, all others score as they
    would alone in a batch; so a batch's outcome must not depend on its other rows. ``repair`` changes the candidates first,
    as a whole, by column expressions. ``watch`` counts ``evaluations`` and ``failures`` of a finished job, repeated tasks once.
    Null cells reach the objective as pandas has them; no candidates give no rows. A table that already has one of the two
    new columns is refused.
    """
    error = f"{name}_error"
    if repair is not None:
        candidates = repair(candidates)
    clash = {name, error} & set(candidates.columns)
    if clash:
        raise ValueError(f"candidates already have {sorted(clash)}")
    kinds = StructType([*candidates.schema.fields, StructField(name, DoubleType()), StructField(error, StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            scores = np.full(len(rows), np.nan)
            errors = np.full(len(rows), None, dtype=object)
            if len(rows):
                _attempt(objective, rows, scores, errors, np.arange(len(rows)))
            yield rows.assign(**{name: scores, error: errors})

    out = candidates.mapInPandas(run, kinds)
    if watch is not None:
        out = out.observe(watch, F.count(F.lit(1)).alias("evaluations"), F.count(error).alias("failures"))
    return out
