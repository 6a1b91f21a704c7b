"""Sets that share a name, and the one row that stays of a group."""

import pyspark.cloudpickle as pickler
from pyspark.sql import functions as F

from llm_plain import naive_join
from sheaf.llm import neardup
from test_free import near_texts, rows


def test_sets_that_share_a_name_stay_apart(spark, monkeypatch):
    whole = neardup.set_key
    # seven names for all sets: many unequal ones share each
    monkeypatch.setattr(neardup, "set_key", lambda s: (whole(s)[0] % 7 + 1, whole(s)[1]) if len(s) else (0, 0))
    pickler.register_pickle_by_value(neardup)
    try:
        texts = near_texts(5, groups=8)
        got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in neardup.join(rows(spark, texts)).collect()}
    finally:
        pickler.unregister_pickle_by_value(neardup)
    assert got == dict(enumerate(naive_join(texts)))


def test_one_row_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = rows(spark, [text, text + " more", text, text, "a b", "a b", "", "", None], [None, None, None, None, 5, 5, 6, 6, 7]).withColumn("first", F.lit("clash"))
    kept = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in neardup.deduplicate(df).collect())
    assert [k[:2] for k in kept] == [(False, 5), (False, 6), (False, 6), (False, 7), (True, 0)]
    assert neardup.deduplicate(df).columns == df.columns
