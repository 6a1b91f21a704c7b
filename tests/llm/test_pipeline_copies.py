"""Exact and near copies of many-line texts, and passages that documents share, through the whole pipeline."""

import collections
import random

import corpus_pipeline
import public_tokenizers
import tokenizers

from llm_plain import naive_join

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def packed_tokens(spark, folder, texts):
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    got = collections.Counter()
    for r in corpus_pipeline.run(spark, str(folder)).collect():
        got[r.doc_id] += r.length
    return got


def test_copies_go_whole_and_passages_line_by_line(spark, tmp_path):
    rng = random.Random(8)
    line = lambda: " ".join(f"the {''.join(rng.choice('abcdefghij') for _ in range(4))} of" for _ in range(rng.choice((1, 3, 5))))
    originals = [[line() for _ in range(n)] for n in (12, 13, 25, 40, 60, 61)]
    passage = [line() for _ in range(9)]
    originals += [[line() for _ in range(30)][:k] + passage + [line() for _ in range(30)] for k in (10, 20, 30)]
    texts = ["\n".join(x) for x in originals]
    exact = texts * 2
    near, changed = [], []
    for x in originals:
        for at in (0, len(x) // 2, len(x) - 1):
            y = [*x[:at], "a changed line " + line(), *x[at + 1 :]]
            near.append("\n".join(y))
            changed.append(y[at])
    rows = texts + exact + near
    linked = [k != c for k, (_, c, _) in enumerate(naive_join(rows))]
    assert all(linked[len(texts) : len(texts) + len(exact)]) and sum(linked[-len(near) :]) > 0.7 * len(near) and not any(linked[: len(texts)])
    got = packed_tokens(spark, tmp_path, rows)
    model = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = lambda t: len(model.encode(t, add_special_tokens=False).ids) + 1
    # nothing is left of exact copies and of near copies at or above the similarity; of the others, what they changed
    assert [i for i in got if linked[i]] == []
    for k, (y, i) in enumerate(zip(changed, range(len(texts) + len(exact), len(rows)), strict=True)):
        assert linked[i] or got[i] == tokens(y), k
    # the passage stays in the first of three documents
    short = [tokens("\n".join(x for x in t if x not in passage)) for t in originals[-2:]]
    assert [got[i] for i in range(len(texts))] == [*map(tokens, texts[:-2]), *short]


def test_documents_without_a_word_left_go(spark, tmp_path):
    rng = random.Random(4)
    line = lambda: " ".join(f"the {''.join(rng.choice('abcdefghij') for _ in range(4))} of" for _ in range(4))
    head, tail = ("\n".join(line() for _ in range(20)) for _ in range(2))
    got = packed_tokens(spark, tmp_path, [f"{head}\nthe middle of a text\n{tail}", head, f"{tail}"])
    assert set(got) == {0}
