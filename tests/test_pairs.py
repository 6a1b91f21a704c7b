"""Next-sentence scores by models: pandas, Arrow, iterators, failures."""

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf
from pyspark.sql.types import DoubleType

from sheaf.operators import chunking, pairs

LONG = "This is a sentence that is long enough to count as one of ordinary length."
TEXT = "\n".join([LONG, "Short but counted.", LONG, LONG, "Another short one.", LONG])


def docs(spark):
    return spark.createDataFrame([(1, TEXT), (2, None), (3, ""), (4, LONG), (5, TEXT + "\n" + LONG * 40), (None, TEXT)], "doc_id long, text string").repartition(2)


def scorers():
    """Made inside a function, so that they go to the workers by value."""

    def rule(a, b):
        return [float(len(x) >= 20 and len(y) >= 20) for x, y in zip(a, b, strict=True)]

    @pandas_udf(DoubleType())
    def by_pandas(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(rule(a, b))

    @pandas_udf(DoubleType())
    def by_iterator(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in parts:
            yield pd.Series(rule(a, b))

    @arrow_udf(DoubleType())
    def by_arrow(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(rule(a.to_pylist(), b.to_pylist()))

    return {"pandas": by_pandas, "iterator": by_iterator, "arrow": by_arrow, "scorer": pairs.PairScorer(lambda: None, lambda _, a, b: rule(a, b), 2)}


def rows(df):
    return sorted(((r.doc_id, r.chunk_no, r.text) for r in df.collect()), key=repr)


@pytest.mark.parametrize("kind", ["pandas", "iterator", "arrow", "scorer"])
def test_a_model_splits_as_the_same_rule_does(spark, kind):
    want = rows(chunking.chunks(docs(spark), "doc_id", next_score=lambda a, b: F.when((F.length(a) >= 20) & (F.length(b) >= 20), 1.0).otherwise(0.0)))
    assert len(want) > 6 and rows(chunking.chunks(docs(spark), "doc_id", next_score=scorers()[kind])) == want


def test_failures_follow_on(spark):
    always = rows(chunking.chunks(docs(spark), "doc_id"))

    def broken():
        raise OSError

    def sometimes(_, a, b):
        if any("Another" in x for x in a + b):
            raise ValueError
        return [None if len(x) < 20 else float("nan") for x in a]

    for scorer in (pairs.PairScorer(broken, lambda *_: []), pairs.PairScorer(lambda: 0, lambda *_: [0.0]), pairs.PairScorer(lambda: 0, sometimes, 3)):
        assert rows(chunking.chunks(docs(spark), "doc_id", next_score=scorer)) == always


def test_a_model_is_loaded_once_a_task(spark, tmp_path):
    def load():
        import uuid

        (tmp_path / uuid.uuid4().hex).write_text("")

    scorer = pairs.PairScorer(load, lambda _, a, b: [1.0] * len(a), 1)
    chunking.chunks(docs(spark).coalesce(1), "doc_id", next_score=scorer).count()
    assert len(list(tmp_path.iterdir())) == 1


def test_other_udfs_are_refused():
    with pytest.raises(TypeError, match="pandas or Arrow"):
        pairs.scorer_of(F.udf(lambda a, b: 1.0, DoubleType(), useArrow=False))
