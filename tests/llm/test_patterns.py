"""Learned phrases, threats and context words: texts in which only a clause's words together decide the label."""

import random

import pytest
from llm_plain import plain_toxicity
from sheaf.llm import toxicity

FILLER = [a + b for a in ("ba", "co", "du", "fe", "gi", "lo", "mu", "na", "pe", "ro") for b in ("ster", "lin", "mond", "cket", "rel", "vish")]


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(11)
    words = lambda n: " ".join(rng.choice(FILLER) for _ in range(n))
    kinds = {
        "aimed": (420, 1, lambda: f"{words(2)} you are {words(rng.randint(0, 3))} florp {words(1)}"),
        "softened": (110, 0, lambda: f"{words(2)} blimp florp {words(2)}"),
        "far": (90, 0, lambda: f"dravel {words(rng.randint(5, 8))} florp {words(1)}"),
        "pair": (110, 1, lambda: f"{words(2)} zim zam {words(2)}"),
        "turned": (130, 0, lambda: f"{words(2)} zam zim {words(2)}"),
        "apart": (130, 0, lambda: f"zim {words(2)} zam {words(1)}"),
        "threat": (110, 1, lambda: f"{words(1)} they will {words(1)} grack {words(2)}"),
        "addressed": (420, 0, lambda: f"{words(2)} you are {words(3)}"),
        "announced": (160, 0, lambda: f"{words(1)} they will {words(3)}"),
        "clean": (500, 0, lambda: words(4)),
    }
    rows = [(f"{words(rng.randint(3, 30))}. {make()}. {words(rng.randint(3, 30))}", kind, toxic) for kind, (n, toxic, make) in kinds.items() for _ in range(n)]
    copied = f"{words(6)} florp {words(6)}. {words(40)}"
    rows += [(copied, "copy", 0)] * 60  # one text many times must not teach its words
    rng.shuffle(rows)
    docs = [(i, text, kind, toxic) for i, (text, kind, toxic) in enumerate(rows)]
    df = spark.createDataFrame(docs, "doc_id long, text string, kind string, toxic int")
    return docs, df.select("doc_id", "text"), df.select("doc_id", "toxic"), toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic")), copied


def test_patterns_learned(planted):
    patterns, copied = planted[3].patterns, planted[4]
    assert set(patterns.pairs) == {"zim zam"}
    assert patterns.words == {"blimp": toxicity.NEGATION, "dravel": toxicity.REPORT}
    assert "grack" in patterns.threats and "florp" not in patterns.threats
    assert not set(copied.replace(".", "").split()) & (set(patterns.words) | patterns.threats)


def test_context_decides_where_the_lexicon_cannot(spark, planted):
    docs, df, labels, learned, _ = planted
    fixed = toxicity.fit(df, labels, learn_patterns=False)
    bare = toxicity.Scorer(fixed.lexicon, fixed.curve, dict.fromkeys(toxicity.FACTORS, 1.0))
    held = {r.doc_id for r in df.where(toxicity.is_held_out(df["doc_id"])).select("doc_id").collect()}
    right = lambda s, kinds: sum((s.score(t) >= toxicity.THRESHOLD) == bool(x) for i, t, k, x in docs if i in held and k in kinds)
    n = lambda kinds: sum(k in kinds for i, _, k, _ in docs if i in held)
    decided = ("softened", "far", "pair", "turned", "apart")
    assert n(decided) > 100
    assert right(learned, decided) > 0.95 * n(decided)
    assert right(learned, ("aimed", "threat", "addressed", "announced", "clean")) > 0.95 * n(("aimed", "threat", "addressed", "announced", "clean"))
    assert right(fixed, decided) < 0.8 * n(decided) and right(bare, decided) < 0.8 * n(decided)
    found = {r.doc_id: r.score for r in toxicity.score(df, learned).collect()}
    assert all(found[i] == pytest.approx(plain_toxicity(learned, t), abs=1e-9) for i, t, _, _ in docs[::7])


def test_word_pairs():
    found = list(toxicity.word_pairs("One two. Three \"four\" five six\nseven"))
    assert [p for p, _ in found] == ["one two", "five six"]
    assert list(toxicity.word_pairs("")) == list(toxicity.word_pairs("alone")) == []
    [(_, a)], [(_, b)] = toxicity.word_pairs("x. a b. y"), toxicity.word_pairs("x. a b. z")
    assert a != b


def test_contexts_are_those_of_every_match():
    s = toxicity.Scorer({"florp": 4.0}, (-4.0, 1.0, 0.5, 0.5))
    kinds = lambda text: set(s.contexts(text)[2])
    assert s.contexts("nothing here") is s.contexts(None) is s.contexts("") is None
    assert s.contexts("a florp. b")[:2] == s.contexts("a florp. c")[:2] != s.contexts("b florp")[:2]
    assert kinds("p q r s florp t v w") == {("before", w) for w in "pqrs"} | {("near", w) for w in "qrs"} | {("after", w) for w in "tv"} | {("plain", "florp")}
    assert ("near", "p") in kinds("p florp") and ("near", "p") not in kinds("p florp. florp")
    assert ("announced", "florp") in kinds("will florp")
