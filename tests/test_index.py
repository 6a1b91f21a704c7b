"""The inverted index in blocks: pruned search against all scores, segments and their versions, and what a crash leaves."""

import collections
import math
import random

import pytest

from sheaf.functions.text import STOP_WORDS
from sheaf.operators import inverted, retrieval
from sheaf.sources import files, segments

SCHEMA = "chunk_id long, text string"
WORDS = [f"w{i}" for i in range(300)]


def corpus(n, seed=0):
    rng = random.Random(seed)
    weights = [1 / (i + 1) for i in range(len(WORDS))]
    return {i: " ".join(rng.choices(WORDS, weights, k=rng.randint(0, 60))) for i in range(n)}


def frame(spark, texts, parts=3):
    return spark.createDataFrame(list(texts.items()), SCHEMA).repartition(parts, "chunk_id")


def toks(t):
    return [w for w in (t or "").split() if w not in STOP_WORDS]


def plain(texts, queries, k):
    """All scores, ranked."""
    tf = {i: collections.Counter(toks(t)) for i, t in texts.items()}
    n, mean = len(texts), sum(sum(c.values()) for c in tf.values()) / len(texts)
    df = collections.Counter(w for c in tf.values() for w in c)
    raw = {w: math.log(n - f + 0.5) - math.log(f + 0.5) for w, f in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    idf = {w: floor if x < 0 else x for w, x in raw.items()}
    out = {}
    for q, text in queries.items():
        asked = collections.Counter(toks(text))
        scores = {}
        for i, c in tf.items():
            dl = sum(c.values())
            s = sum(m * idf[w] * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * dl / mean)) for w, m in asked.items() if w in c)
            if s > 0:
                scores[i] = s
        best = max(scores.values(), default=1)
        ranked = sorted((-math.floor(s / best * 10**4 + 0.5000001) / 10**4, i) for i, s in scores.items())[:k]
        out |= {(q, r + 1): (i, -s) for r, (s, i) in enumerate(ranked)}
    return out


def found(index, asked, k=5):
    return {(r.query_id, r.sparse_rank): (r.chunk_id, r.sparse_score) for r in retrieval.sparse_topk(index, asked, k).collect()}


def asks(spark, queries):
    return spark.createDataFrame(list(queries.items()), "query_id string, query string")


def test_pruned_search_equals_all_scores(spark, monkeypatch):
    texts = corpus(700) | {900: None, 901: "", 902: "w5 w5 w5", 903: "w5 w5 w5"}
    queries = {f"q{i}": t for i, t in corpus(12, 5).items()} | {"rare": "w299 w298", "none": "nothing here", "twice": "w5 w5 w7", "empty": ""}
    blocks = inverted.blocks_of(frame(spark, texts), size=40)
    stats = inverted.corpus_stats(blocks)
    index = inverted.Index(blocks, inverted.term_weights(inverted.term_counts(blocks), stats), stats, None, 18)
    want = plain(texts, queries, 5)
    assert found(index, asks(spark, queries)) == want
    monkeypatch.setattr(inverted, "ONE_PASS", 4)
    assert found(index, asks(spark, queries)) == want
    work = {r.query_id: r for r in inverted.search_work(index, retrieval.query_terms(asks(spark, queries)), 5).collect()}
    assert all(r.scored <= r.sharing for r in work.values()) and sum(r.scored for r in work.values()) < 0.7 * sum(r.sharing for r in work.values())


def test_a_tenth_of_the_pairs_is_scored(spark, data):
    """On the documents of sf0.1: what the blocks' bounds leave."""
    at = data.replace("0.001", "0.1")
    docs = spark.read.parquet(f"{at}/documents.parquet").selectExpr("doc_id AS chunk_id", "text").repartition(4)
    path = f"{inverted.written(docs.limit(0), 'x').sparkSession.sparkContext.getCheckpointDir()}/tenth"
    segments.rebuild(docs, path)
    index = segments.open_index(spark, path)
    queries = spark.read.parquet(f"{at}/benchmark.parquet").selectExpr("item_id AS query_id", "text AS query")
    work = inverted.search_work(index, retrieval.query_terms(queries), 10).agg({"scored": "sum", "sharing": "sum"}).first()
    assert work["sum(sharing)"] > 1_000_000 and work["sum(scored)"] <= 0.1 * work["sum(sharing)"]


def test_changes_equal_a_rebuild(spark, tmp_path):
    path, texts, queries = str(tmp_path / "i"), corpus(120), {f"q{i}": t for i, t in corpus(6, 9).items()}

    def holds(now):
        index = segments.open_index(spark, path)
        assert found(index, asks(spark, queries)) == plain(now, queries, 5)
        assert {r.chunk_id for r in index.chunks.collect()} == set(now)
        fresh = inverted.index_of(frame(spark, now))
        assert {(r.term, r.df) for r in index.terms.collect()} == {(r.term, r.df) for r in fresh.terms.collect()}
        assert index.stats.first() == fresh.stats.first()

    segments.rebuild(frame(spark, texts), path)
    holds(texts)
    before = segments.manifest(spark, path)
    assert segments.upsert(frame(spark, {3: texts[3]}), path) == before  # the same text: no new version
    changed = {5: "w1 w2 new", 300: "w299 w299", 301: None}
    segments.upsert(frame(spark, changed), path)
    texts |= changed
    holds(texts)
    segments.delete(frame(spark, {i: "" for i in range(40, 60)}).select("chunk_id"), path)
    texts = {i: t for i, t in texts.items() if not 40 <= i < 60}
    holds(texts)
    texts = {i: t for i, t in texts.items() if i % 9} | {5: "again other", 400: "w7"}
    segments.sync(frame(spark, texts), path)
    holds(texts)
    merged = segments.compact(spark, path, most=1)
    assert len(merged.segments) == 2
    holds(texts)
    segments.vacuum(spark, path)
    assert set(files.names(spark, path)) == {*merged.segments, merged.terms, "manifests"} | ({merged.dead} if merged.dead else set())
    holds(texts)
    segments.sync(frame(spark, {}), path)
    assert segments.open_index(spark, path).chunks.count() == 0 and found(segments.open_index(spark, path), asks(spark, queries)) == {}


def test_only_new_texts_are_tokenised(spark, tmp_path, monkeypatch):
    path, texts = str(tmp_path / "i"), corpus(200)
    segments.rebuild(frame(spark, texts), path)
    seen = []
    blocks_of = inverted.blocks_of
    monkeypatch.setattr(inverted, "blocks_of", lambda c, *a, **b: seen.append(c.count()) or blocks_of(c, *a, **b))
    segments.sync(frame(spark, texts | {7: "changed", 500: "added"}), path)
    assert seen == [2]


@pytest.mark.parametrize("step", ["segment", "terms", "dead", "draft", "rename"])
def test_a_crash_leaves_the_version_before(spark, tmp_path, monkeypatch, step):
    path, texts, queries = str(tmp_path / "i"), corpus(60), {"q": "w3 w5 w9"}
    segments.rebuild(frame(spark, texts), path)
    before = found(segments.open_index(spark, path), asks(spark, queries))
    after = texts | {4: "w3 w3 w3", 99: "w5 w9"}

    class Crash(Exception):
        pass

    def crash(*_, **__):
        raise Crash

    with monkeypatch.context() as m:
        if step == "segment":
            m.setattr(segments, "_totals", crash)  # the segment is written, nothing after it
        elif step == "terms":
            m.setattr(inverted, "term_weights", crash)
        elif step == "dead":
            m.setattr(segments, "_finish", crash)
        elif step == "draft":
            m.setattr(files, "write_text", crash)
        else:
            m.setattr(files, "rename", crash)
        with pytest.raises(Crash):
            segments.sync(frame(spark, after), path)
    assert found(segments.open_index(spark, path), asks(spark, queries)) == before
    segments.sync(frame(spark, after), path)
    assert found(segments.open_index(spark, path), asks(spark, queries)) == plain(after, queries, 5)


def test_a_second_writer_is_refused(spark, tmp_path):
    path = str(tmp_path / "i")
    made = segments.rebuild(frame(spark, corpus(10)), path)
    with pytest.raises(files.Conflict):
        segments._commit(spark, path, made)
    assert segments.manifest(spark, path) == made
