"""Language, fingerprints and toxicity against plain versions of their results; caps that must not be."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_plain import alike, order_minhash, out_of_place, plain_toxicity, ranked_grams
from sheaf.llm import bpe, fingerprints, language, toxicity
from test_free import MODEL, naive_grams
from test_native import ODD, naive_edit

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows(spark, texts, ids=None, langs=None):
    ids, langs = ids or range(len(texts)), langs or ["en"] * len(texts)
    return spark.createDataFrame([(i, t, x, "s", len(t or "")) for i, t, x in zip(ids, texts, langs, strict=True)], SCHEMA)


# --- language -------------------------------------------------------------------------------------------------------

def test_predictions_equal_plain_out_of_place(spark):
    rng = random.Random(4)
    pools = {"a": "abcdeé", "b": "cdefg", "c": "efghiü"}
    make = lambda x, n: " ".join("".join(rng.choice(pools[x]) for _ in range(rng.randint(1, 7))) for _ in range(n))
    texts = [(x, make(x, rng.randint(1, 60))) for x in "abc" for _ in range(12)]
    profiles = {}
    for x in "abc":
        total = sum((naive_grams(t) for y, t in texts if y == x), start=naive_grams(""))
        profiles[x] = ranked_grams(total)
    fitted = language.fit(rows(spark, [t for _, t in texts], langs=[x for x, _ in texts]))
    asked = [make(x, n) for x in "abc" for n in (1, 4, 40, 400)] + ["zz 1"]
    found = {r.doc_id: r for r in language.identify(rows(spark, asked).withColumn("score", F.lit("clash")), fitted).collect()}
    for i, t in enumerate(asked):
        mine = ranked_grams(naive_grams(t))
        far = out_of_place(profiles, mine)
        best = min(sorted(far), key=far.get)
        assert (found[i].lang_pred, found[i].score) == (best, pytest.approx(1 - far[best] / (300 * len(mine)), abs=1e-12))


def test_every_language_is_learned(spark):
    rng = random.Random(6)
    words = [["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(6)] for _ in range(600)]
    texts = [" ".join(w) for w in words]
    fitted = language.fit(rows(spark, texts, langs=[f"l{k:03d}" for k in range(600)]))
    assert len(fitted.names) == 600
    assert all(fitted.predict(" ".join(reversed(w)))[0] == f"l{k:03d}" for k, w in enumerate(words))


# --- fingerprints ---------------------------------------------------------------------------------------------------

def test_fingerprints_equal_a_plain_order_minhash(spark):
    rng = random.Random(11)
    texts = ODD + [" ".join(rng.choice(("a", "bb", "longerword" * 3, "é", "中文")) + str(rng.randint(0, 40)) for _ in range(n)) for n in (1, 2, 5, 7, 8, 20, 63, 64, 65, 200, 900)]
    texts += ["".join(rng.choice("abcdef") for _ in range(n)) for n in (3, 17, 500)]
    ids = rng.sample(range(10**6), len(texts))
    out = {r.doc_id: r for r in fingerprints.fingerprint_edits(rows(spark, texts, ids).withColumns({"_bucket": F.lit("clash"), "fingerprint": F.lit(1)})).collect()}
    by_id = dict(zip(ids, texts, strict=True))
    edits, down = naive_edit(by_id), sorted(ids, reverse=True)
    shown = lambda e: "".join(f"{x:06x}" for x in e)
    for k, i in enumerate(down):
        mine, edited, following = order_minhash(by_id[i]), order_minhash(edits[i]), order_minhash(by_id[down[(k + 1) % len(down)]])
        assert (out[i].fingerprint, out[i].edited_fingerprint) == (shown(mine), shown(edited))
        assert out[i].near_edited == pytest.approx(alike(mine, edited)) and out[i].near_next == pytest.approx(alike(mine, following))


@pytest.mark.parametrize("base", [0, 2**62, -(2**62)])
def test_ids_of_any_size(spark, monkeypatch, base):
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", 200)
    rng = random.Random(2)
    texts = [f"text {i} " * rng.randint(0, 9) for i in range(400)]
    ids = rng.sample(range(base, base + 900), 400)
    out = {r.doc_id: r.edited_sha256 for r in fingerprints.fingerprint_edits(rows(spark, texts, ids)).collect()}
    import hashlib

    assert out == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in naive_edit(dict(zip(ids, texts, strict=True))).items()}


def test_likeness_without_blanks(spark):
    rng = random.Random(3)
    t = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3000))
    f = fingerprints.fingerprint
    r = rows(spark, [t]).select(fingerprints.likeness(f(F.col("text")), f(F.concat(F.lit("x"), "text"))).alias("s")).first()
    assert r.s >= 0.8


# --- toxicity -------------------------------------------------------------------------------------------------------

def test_scores_equal_plain_definitions(spark):
    lexicon = {"idiot": 4.0, "idiotype$": 0.0, "scu": 2.5, "tras": 1.25}
    learned = toxicity.Patterns({"plain such": 3.0, "a of": 2.0}, frozenset({"trash"}), {"blimp": toxicity.NEGATION, "dravel": toxicity.REPORT, "mate": toxicity.TARGET})
    s = toxicity.Scorer(lexicon, (-4.0, 0.7, 0.5, 0.25), toxicity.FACTORS | {"negated": 0.4, "threat": 1.5}, learned)
    rng = random.Random(5)
    words = ["idiot", "idiots", "idiotype", "scum", "trash", "kill", "you", "he's", "you’re", "are", "not", "don’t", "said", '"', "will", "i", "a", "blimp", "dravel", "mate", "plain", "piece", "of", "piece of trash", "shut up", "go to hell", "watch your back", "such", ".", "!", "\n", "x_idiot", "o'idiot"]
    texts = [None, "", "plain words"] + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(400)]
    found = {r.doc_id: r.score for r in toxicity.score(rows(spark, texts).withColumn("score", F.lit("clash")), s).collect()}
    for i, t in enumerate(texts):
        assert found[i] == pytest.approx(plain_toxicity(s, t), abs=1e-9), t
    assert len({round(x, 6) for x in found.values()}) > 100


def test_patterns_of_several_words():
    s = toxicity.Scorer({"idiot": 4.0}, (-4.0, 1.0, 0.5, 0.5))
    assert s.clause("you are a piece of trash") > s.clause("a piece of trash") > 0 == s.clause("a piece of cake")
    assert s.clause("i will kill you") > s.clause("kill you") > s.clause("kill time") and s.clause("go to hell") > 0
    assert s.clause("you are an idiot") > s.clause("you and an idiot") and s.features("don’t be an idiot") == s.features("don't be an idiot") < s.features("be an idiot")


def test_factors_follow_the_labels():
    powers = [[0] * len(toxicity.NAMES) for _ in range(2)]
    powers[1][0] = 1  # negated
    plain, negated = [[[4.0, powers[0]]]], [[[4.0, powers[1]]]]
    fit = lambda toxic: toxicity.Sample([(1, plain, 50), (0, [], 200), (toxic, negated, 50)]).fit()[1]["negated"]
    assert fit(0) < toxicity.FACTORS["negated"] < fit(1)


# --- BPE ------------------------------------------------------------------------------------------------------------

def test_cache_is_bounded_in_bytes(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 1 << 20)
    own = bpe.Codec.from_json(bpe.read_vocabulary(MODEL))
    rng = np.random.default_rng(0)
    for _ in range(40):
        words = ["".join(map(chr, rng.integers(97, 123, 20_000))) for _ in range(10)]
        for t, x in zip(words, own.encode(words), strict=True):
            assert own.decode(x) == t.encode()
        assert sum(len(k) + len(v) for k, v in own.cache.items()) <= 1 << 20
