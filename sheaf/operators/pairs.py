"""Scores of neighbouring sentences by a model, in batches.

Sentences stay in their document's row: an Arrow batch of rows is one run of sentences, its neighbouring pairs go to the scorer some hundred at a time, and the
scores come back as a list beside the sentences, so nothing is shuffled. A model is loaded once for each task. A batch that the scorer fails
on, a score that is null or not a number, and every score of a model that cannot be loaded are 1: the sentence follows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.util import PythonEvalType

from sheaf.session import ship

FOLLOWS = 1.0


@dataclass(frozen=True)
class PairScorer:
    """``load()`` makes the model, ``score(model, previous, sentences)`` scores two lists of texts of the same length; ``batch``: pairs at a time."""

    load: Callable[[], Any]
    score: Callable[[Any, list[str], list[str]], Any]
    batch: int = 256


class _Fed:
    """The input of a user's iterator function: what is put in is what it reads next."""

    def __init__(self) -> None:
        self.held: list = []

    def __iter__(self) -> Iterator:
        return self

    def __next__(self):
        return self.held.pop()


class _Stream:
    """An iterator function kept running, so that what it loads at its beginning is loaded once; it begins again after a failure."""

    def __init__(self, func: Callable) -> None:
        self.func, self.fed, self.out = func, _Fed(), None

    def __call__(self, a, b):
        if self.out is None:
            self.fed = _Fed()
            self.out = iter(self.func(self.fed))
        self.fed.held.append((a, b))
        try:
            return next(self.out)
        except Exception:
            self.out = None
            raise


def scorer_of(next_score: Any) -> PairScorer | None:
    """A scorer of what was given: itself, or a pandas or Arrow UDF of two texts (plain or over an iterator); nothing for a column function."""
    if isinstance(next_score, PairScorer):
        return next_score
    kind = getattr(next_score, "evalType", None)
    if kind is None:
        return None
    func = next_score.func
    pandas = (PythonEvalType.SQL_SCALAR_PANDAS_UDF, PythonEvalType.SQL_SCALAR_PANDAS_ITER_UDF)
    arrow = (PythonEvalType.SQL_SCALAR_ARROW_UDF, PythonEvalType.SQL_SCALAR_ARROW_ITER_UDF)
    if kind not in pandas + arrow:
        raise TypeError("a scorer must be a pandas or Arrow UDF of two texts")

    def column(x: list[str]):
        if kind in arrow:
            return pa.array(x, pa.string())
        import pandas as pd

        return pd.Series(x, dtype=object)

    runs_on = kind in (pandas[1], arrow[1])
    return PairScorer(lambda: _Stream(func) if runs_on else func, lambda f, a, b: f(column(a), column(b)))


def scored(docs: DataFrame, scorer: PairScorer, sentences: str = "s", name: str = "next_scores") -> DataFrame:
    """``docs`` with a list of scores, one a sentence: that of the pair with the sentence before it, 1 for the first."""
    ship(docs.sparkSession)
    at = docs.columns.index(sentences)

    def run(batches):
        try:
            model, works = scorer.load(), True
        except Exception:  # noqa: BLE001  a model that is not there must not stop the chunking
            model, works = None, False
        for b in batches:
            column = b.column(at)
            texts = column.flatten().to_pylist()
            sizes = np.asarray(column.value_lengths().fill_null(0))
            starts = np.cumsum(np.append(0, sizes))
            out = np.full(len(texts), FOLLOWS)
            first = np.zeros(len(texts) + 1, bool)
            first[starts] = True
            pairs = np.flatnonzero(~first[:-1])
            for i in range(0, len(pairs) if works else 0, scorer.batch):
                part = pairs[i : i + scorer.batch]
                try:
                    got = scorer.score(model, [texts[p - 1] for p in part], [texts[p] for p in part])
                    got = got.to_pylist() if isinstance(got, (pa.Array, pa.ChunkedArray)) else list(got)
                    if len(got) == len(part):
                        out[part] = [FOLLOWS if x is None or math.isnan(x) else x for x in got]
                except Exception:  # noqa: BLE001  a failing batch follows on
                    continue
            lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(out))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], [*b.schema.names, name])

    return docs.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in docs.dtypes) + f", {name} array<double>")
