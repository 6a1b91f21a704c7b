"""Fingerprints of texts without white space and of short ones."""

import random

from pyspark.sql import functions as F

from sheaf.llm import fingerprints

SCHEMA = "doc_id long, text string"


def likeness(spark, pairs):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i long, a string, b string")
    f = fingerprints.fingerprint
    return [r.s for r in df.select("i", fingerprints.likeness(f(F.col("a")), f(F.col("b"))).alias("s")).orderBy("i").collect()]


def test_an_inserted_character_leaves_most_of_an_unspaced_text(spark):
    rng = random.Random(5)
    texts = ["".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(n)) for n in (40, 200, 2000)] + ["".join(rng.choice("abcdefghij") for _ in range(3000))]
    got = likeness(spark, [(t, t[:3] + "é" + t[3:]) for t in texts] + [(texts[1], texts[2]), (texts[0], texts[1])])
    assert min(got[:4]) > 0.7 and max(got[4:]) < 0.1


def test_one_edit_of_a_short_text(spark):
    texts = ["fingerprinting", "a short sentence", "neural networks", "understanding", "these are five plain words"]
    got = likeness(spark, [(t, t[:-2] + "x" + t[-1:]) for t in texts] + [("a short sentence", "unlike in all ways")])
    assert min(got[:5]) > 0.4 and got[5] < 0.2


def test_likeness_has_no_step_where_texts_grow(spark):
    words = [f"w{i * 7919 % 1000}" for i in range(90)]
    got = likeness(spark, [(" ".join(words[:n]), " ".join(words[: n + 1])) for n in range(4, 80)])
    assert min(got) > 0.4
