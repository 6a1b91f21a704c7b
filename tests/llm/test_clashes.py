"""Extra columns named like results, repeated rows and very long texts in sharding, packing and encoding."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import tokenizers
from pyspark.sql import functions as F
from sheaf.llm import bpe, packing, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(random.Random(3).choice(["rolling", "stone", "中文", "it's", "x9", "–", "\n"]) for _ in range(250_000))
TEXTS = [LONG, None, "", "a b", "a b", "word " * 3000, "ünï 中文"]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(min(i, 5), t, "en", "s", 0) for i, t in enumerate(TEXTS)], SCHEMA)


def clashing(df, *names):
    return df.select("*", *(F.lit("clash").alias(n) for n in names))


def plain(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def test_sharding(frame):
    columns = ("doc_id", "size", "text_crc32", "shard", "slot")
    clash = sharding.shard_by_bytes(clashing(frame, "size", "text_crc32", "shard", "slot", "group_hash", "_row", "_cell", "_large", "law", "ord"), 4)
    assert plain(clash, *columns[:4]) == plain(sharding.shard_by_bytes(frame, 4), *columns[:4])
    found = plain(clash, *columns)
    assert [r[:3] for r in found] == sorted((min(i, 5), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in enumerate(TEXTS))
    assert all(sorted(r[4] for r in found if r[3] == s) == list(range(sum(r[3] == s for r in found))) for s in range(4))


def test_packing(frame):
    columns = ("doc_id", "piece", "start", "length", "ids_crc32")
    names = ("piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset", "_row", "_cell", "_plan", "_rank", "_slot")
    found = packing.pack_documents(clashing(frame, *names)).collect()
    model = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, t in enumerate(TEXTS):
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 2]
        cuts = [0, *range(len(ids) % 1024 or min(len(ids), 1024), len(ids) + 1, 1024)]
        want += [(min(i, 5), k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted(tuple(r[c] for c in columns) for r in found) == sorted(want)
    by_sequence = {}
    for r in found:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in map(sorted, by_sequence.values()):
        assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))] and sum(n for _, n in places) <= 1024


def test_encoding(spark, frame, tmp_path):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    clashing(frame, "n_tokens", "ids", "ids_sha256", "decoded_sha256", "offsets").write.parquet(str(tmp_path / "documents.parquet"))
    from tiktoken.load import load_tiktoken_bpe

    library = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(path), special_tokens={})
    want = []
    for i, t in enumerate(TEXTS):
        ids = library.encode_ordinary(t or "")
        want.append((min(i, 5), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert plain(bpe.op8_bpe(spark, str(tmp_path)), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want)
