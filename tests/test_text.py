import re
from functools import reduce

import pytest
from pyspark.sql import functions as F

from sheaf.functions import rules
from sheaf.functions import text as T
from sheaf.operators import chunking


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v"))).first()[0]


def test_tokens_join_units_and_drop_stop_words(spark):
    assert one(spark, "Apply neem oil 2ml/L for fruit fly control", T.tokens) == ["apply", "neem", "oil", "2ml_per_l", "fruit", "fly", "control"]
    assert one(spark, "a/b/c", T.tokens) == ["a_per_b"]
    assert one(spark, None, T.tokens) == []


def python_clean(t):
    """The same rules by Python's own expressions."""
    t = reduce(lambda x, p: re.sub("(?im)" + p, " ", x), T.NOISE, t or "")
    t = re.sub(r"(\w+)\s*/\s*(\w+)", r"\1/\2", re.sub(r"-\s*\n\s*", "", t))
    t = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", t))
    return reduce(lambda x, p: x.replace(*p), T.LITERALS, t).strip()


RAW = [
    "irri-\ngation kg /ha and t/ ha", "a  b\t c\n\n\n\nd", "Source : page 3\nkept\n  12  \nnext", "dots ...... end", "5 @ 10 and Oo 5", None, "", " \u00a0x\u2003 ",
    "tnau guide COIMBATORE line\r\nnext \u00e9/\u00fc / b\r\n 7 \r\nend", "published BY someone\nPackage of practices x\nrest\x0cpage", "1\n22\n333\n4444\n", "a - \n b / c/ d",
]


def test_clean_text_reads_as_python_does(spark):
    out = spark.createDataFrame(list(enumerate(RAW)), "i int, t string").select("i", T.clean_text(F.col("t")).alias("c")).orderBy("i").collect()
    assert [r.c for r in out] == [python_clean(t) for t in RAW]
    assert out[0].c == "irrigation kg/ha and t/ha" and out[5].c == ""


def test_sentences_and_answers(spark):
    assert one(spark, "First sentence is here. Short. Second sentence\nthird line of text", T.sentences) == ["First sentence is here.", "third line of text"]
    assert one(spark, "# Head of text. A real sentence here. | cell | x. **bold text line** Fine answer sentence!", T.answer_sentences) == ["A real sentence here."]


@pytest.mark.parametrize(("s", "hard"), [("Pests of rice", True), ("3. Apply now", True), ("2) Remove", True), ("GROUND NUT", True), ("Plain words", False), ("ABC", False), ("an irrigation", False)])
def test_hard_boundary(spark, s, hard):
    assert one(spark, s, T.is_hard_boundary) is hard


def test_crop_tags_are_substrings(spark):
    assert one(spark, "The price of tomatoes and steam", T.crop_tags) == ["rice", "tomato", "tea"]


def test_table_to_text(spark):
    rows = [["Crop", "Seed rate", ""], ["Tomato", "400g/ha", "x"], ["", "5"], [None, None]]
    assert one(spark, rows, chunking.table_to_text, "array<array<string>>") == "Crop: Tomato | Seed rate: 400g/ha\nSeed rate: 5"
    assert one(spark, [["Crop"]], chunking.table_to_text, "array<array<string>>") == ""


def python_fold(sentences, hard):
    out, cur, size = [], [], 0
    for i, s in enumerate(sentences):
        if i and (hard(s) or size + len(s) > 500):
            out.append(" ".join(cur))
            cur, size = [s], len(s)
        else:
            cur.append(s)
            size += len(s)
    return [c for c in [*out, " ".join(cur)] if len(c) >= 50]


def test_chunk_fold_equals_a_loop(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    made = {}
    for r in chunking.chunks(docs, "doc_id").orderBy("doc_id", "chunk_no").collect():
        made.setdefault(r.doc_id, []).append(r.text)
    for r in docs.select("doc_id", T.sentences(F.col("text")).alias("s")).collect():
        assert made.get(r.doc_id, []) == (python_fold(r.s, lambda s: s.startswith("Pest")) if r.s else [])


def test_ids_are_contiguous(spark):
    rows = spark.createDataFrame([(b, i) for b in "cab" for i in range(3)], "g string, i int")
    ids = [r.chunk_id for r in chunking.with_ids(rows, ["g", "i"], 7).orderBy("g", "i").collect()]
    assert ids == [f"chunk_{k:06d}" for k in range(7, 16)]


def test_full_text_order(spark):
    rows = spark.createDataFrame([("f", 2, "b", ["t"]), ("f", 1, "a", None), ("g", 1, None, [])], "filename string, page_number int, text string, tables_text array<string>")
    assert {r.filename: r.text for r in chunking.full_text(rows).collect()} == {"f": "a\nb\nt\n", "g": "\n"}


def test_rule_tables():
    assert (len(rules.STAGES), sum(len(a) for a, _ in rules.STAGES.values()), sum(len(b) for _, b in rules.STAGES.values())) == (15, 112, 93)
    assert all(len(s) == 12 for s in rules.CALENDAR.values())
