"""The queries of this subpackage, by name."""

from __future__ import annotations

import corpus_pipeline

from . import bpe, fingerprints, language, lines, merkle, neardup, oracles, packing, quality, sharding, toxicity, urls, vectors, warc

QUERIES = {
    "op1_language": language.op1_language,
    "op2_fingerprints": fingerprints.op2_fingerprints,
    "op3_lines": lines.op3_lines,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_sharding": sharding.op5_sharding,
    "op6_warc": warc.op6_warc,
    "op7_neardup": neardup.op7_neardup,
    "op8_bpe": bpe.op8_bpe,
    "op9_packing": packing.op9_packing,
    "op10_quality": quality.op10_quality,
    "op11_codes": vectors.op11_codes,
    "op12_manifest": merkle.op12_manifest,
    "op13_urls": urls.op13_urls,
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = {
    "op6_warc": oracles.ARCHIVES,
    "op7_neardup": oracles.NEAR,
    "op10_quality": oracles.QUALITY,
    "op11_codes": oracles.CODES,
    "op12_manifest": oracles.MANIFEST,
    "op13_urls": oracles.URLS,
} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
