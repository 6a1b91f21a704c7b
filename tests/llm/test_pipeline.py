"""The pipeline against its stages' plain versions, and that it passes over odd rows."""

import collections

import corpus_pipeline
import public_tokenizers
import tokenizers
from pyspark.sql import functions as F

from llm_plain import cut, measured, naive_join, naive_lines
from sheaf.llm import language, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_run_equals_plain_stages(spark, data):
    df = spark.read.parquet(f"{data}/documents.parquet")
    docs = {r.doc_id: r for r in df.collect()}
    kept = {}
    for i, r in docs.items():
        n, chars, symbols, dups, repeats, upper, letters, n_lines = measured(r.text)
        bad = n < 50 or 2 * repeats > n or 10 * symbols > n or n_lines >= 4 and 2 * dups > n_lines or letters >= 40 and 2 * upper > letters or 2 * chars < 5 * n or chars > 14 * n or 2 * letters < chars
        if not bad:
            kept[i] = r
    first = spark.createDataFrame([kept[i] for i in sorted(kept)], df.schema)
    profiles = language.fit(language.training_rows(first))
    kept = {i: r for i, r in kept.items() if (p := profiles.predict(r.text))[0] != "und" and p[1] >= language.LEAST_SCORE}
    ids = sorted(kept)
    near = dict(zip(ids, naive_join([kept[i].text for i in ids]), strict=True))
    gone = naive_lines([(i, kept[i].text) for i in ids], {i: near[i][1] for i in ids})
    texts = {i: cut(kept[i].text, gone[i]) for i in ids}
    ids = [i for i in ids if texts[i] or not gone[i]]
    near = naive_join([texts[i] for i in ids])
    left = [i for k, i in enumerate(ids) if near[k][1] == k]
    model = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: len(model.encode(texts[i], add_special_tokens=False).ids) + 1 for i in left}
    got = collections.Counter()
    for r in corpus_pipeline.run(spark, data).collect():
        got[r.doc_id] += r.length
    assert dict(got) == want


def test_stages_keep_columns_and_pass_odd_rows(spark, data):
    good = " ".join(f"the word{i} and some{i % 17} of more{i % 13}" for i in range(60))
    odd = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, good, "en", None, len(good)), (3, good, "en", None, len(good)), (None, good + " tail", None, "s", 5), (5, "x " * 200_000, "en", "s", 400_000), (6, good + " more", "en", "s", 9)]
    for docs in (spark.createDataFrame(odd, SCHEMA), spark.createDataFrame([], SCHEMA)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs.withColumn("key", F.lit(1)).withColumn("row", F.lit("x")), data)
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "key", "row"], name
            docs = docs.drop("key", "row")
        assert corpus_pipeline.STAGES[-1][1](spark, docs, data).count() >= 0


def test_registered():
    names = set(queries.queries())
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 11)) and "pipeline" in names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "line_dedup", "near_duplicates", "best_fit_packing"]
