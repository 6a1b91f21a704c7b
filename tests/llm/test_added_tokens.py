"""Added tokens of a vocabulary against the public library's default."""

import collections
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import tokenizers

from sheaf.llm import bpe, packing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
MODEL = public_tokenizers.path("byte_bpe_50k.json")
MARK = "<|endoftext|>"
TEXTS = [f"a {MARK} b", MARK, f"{MARK}{MARK} x", f"it'{MARK}s  {MARK}  ", "<|endoftext|", "plain text", "", f"w {MARK} " * 900, f"\n{MARK}\n\n中文{MARK}é"]


def want():
    model = tokenizers.Tokenizer.from_file(MODEL)
    return [model.encode(t, add_special_tokens=False).ids for t in TEXTS]


def test_codec_equals_the_library():
    own = bpe.Codec.from_json(bpe.read_vocabulary(MODEL), added=True)
    found = list(own.encode(TEXTS))
    assert [np.frombuffer(x, "<u4").tolist() for x in found] == want()
    assert len(want()[0]) == 4 and [own.decode(x).decode() for x in found] == TEXTS


def test_packing_counts_added_tokens(spark, tmp_path):
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(TEXTS)], SCHEMA)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    for out in (packing.op9_packing(spark, str(tmp_path)), corpus_pipeline.best_fit_packing(spark, df, "")):
        by_doc = collections.defaultdict(list)
        for r in out.collect():
            by_doc[r.doc_id].append(r)
        for i, ids in enumerate(want()):
            ids = [*ids, 2]
            assert sum(r.length for r in by_doc[i]) == len(ids)
            assert all(r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for r in by_doc[i])
