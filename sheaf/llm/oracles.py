"""SQL twins (DuckDB dialect) of the queries that SQL can express over whole tables."""

from __future__ import annotations

from .merkle import FIELDS
from .quality import CURRENT, RULE_NAMES, mask_of
from .urls import LOWER, RULES, UPPER
from .vectors import ENTRIES, PARTS, ROUNDS, SCALE

_WORD = r"[^\x20\x09-\x0D]+"
_count = lambda cls: f"(length(t) - length(regexp_replace(t, '{cls}', '', 'g')))"
#: Failing conditions by rule, in the order of the bits.
_RULES = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "n_lines >= 4 AND 2 * n_dup_lines > n_lines",
    "shouting": "n_letters >= 40 AND 2 * n_upper > n_letters",
    "short_words": "2 * word_chars < 5 * n_words",
    "long_words": "word_chars > 14 * n_words",
    "few_letters": "2 * n_letters < word_chars",
}
_bits = " + ".join(f"CASE WHEN {_RULES[name]} THEN {1 << i} ELSE 0 END" for i, name in enumerate(RULE_NAMES))

QUALITY = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
r AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
c AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM r) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM c) GROUP BY doc_id),
m AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, {_count('[#*$%&|<>]+')} AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
    coalesce(cov.n, 0) AS n_repeat_words, {_count(r'\p{Lu}+')} AS n_upper, {_count(r'\p{L}+')} AS n_letters, len(l) AS n_lines FROM w LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, CAST({_bits} AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & {mask_of('base')} <> 0 AS base_failed, fail_bits & {mask_of(CURRENT)} = 0 AS kept, fail_bits FROM b"""

ARCHIVES = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha256(coalesce(html, '')) AS d FROM pages),
g AS (SELECT d, min(page_id) AS first FROM p WHERE strlen(h) >= 100 GROUP BY d)
SELECT page_id, strlen(h) AS payload_bytes, p.d AS payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id <> first THEN first END AS refers_to FROM p LEFT JOIN g ON g.d = p.d"""

NEAR = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM i JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * k >= 80 * (nx.n + ny.n - k)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS z FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.z)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, coalesce(d.k, 0) AS n_links FROM w LEFT JOIN n USING (doc_id)
    JOIN (SELECT doc_id, min(z) AS component_id FROM r GROUP BY doc_id) c USING (doc_id) LEFT JOIN (SELECT x AS doc_id, count(*) AS k FROM e GROUP BY x) d USING (doc_id)"""

_quoted = lambda x: "'" + x.replace("'", "''") + "'"
_fits = " + ".join(
    f"CASE WHEN (host = {_quoted(h)} OR ends_with(host, {_quoted('.' + h)})) AND starts_with(path, {_quoted(p)}) THEN [{{'n': {len(h + p)}, 'm': {len(h)}, 'verdict': {_quoted(v)}, 'rule': {_quoted(h + p)}}}] ELSE [] END"
    for v, h, p in RULES).replace(" + CASE", " || CASE")
URLS = rf"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(coalesce(url, ''), '(?s)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
b AS (SELECT *, list_sort({_fits}, 'DESC')[1] AS best FROM u)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM b"""


def _manifest(levels: int = 7, outer: int = 3) -> str:
    """Trees of up to ``8 ** levels`` leaves a language and ``8 ** outer`` languages; a level above a tree's top changes nothing."""

    def encoded(c: str, of: str) -> str:
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE CAST(strlen(CAST({of} AS VARCHAR)) AS VARCHAR) || ':' || CAST({of} AS VARCHAR) END"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(encoded(f, text if f == "text" else f) for f in FIELDS) + ")"

    crc = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(d) + 1), lambda i: CAST(ascii(d[i]) AS BIGINT))),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: xor(a >> 1, 3988292384 * (a & 1)))))"""
    parts = [f"""d AS (SELECT *, CAST(doc_id AS VARCHAR) AS d FROM documents),
l AS (SELECT doc_id, lang, {leaf('text')} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} ELSE {leaf('text')} END AS cur FROM d),
c0 AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, '' AS proof FROM l),
n0 AS (SELECT lang, i, leaf AS h, count(*) OVER (PARTITION BY lang) AS n FROM c0)"""]

    def climb(n: str, r: str, c: str, depth: int) -> None:
        for j in range(1, depth + 1):
            parts.append(f"{r}{j} AS (SELECT lang, i // 8 AS r, string_agg(h, '' ORDER BY i) AS s, any_value(n) AS n FROM {n}{j - 1} GROUP BY lang, i // 8)")
            parts.append(f"{n}{j} AS (SELECT lang, r AS i, CASE WHEN n > 1 THEN sha256(s) ELSE s END AS h, (n + 7) // 8 AS n FROM {r}{j})")
            before, after = "substr(s, 1, 64 * (i % 8))", "substr(s, 64 * (i % 8) + 65)"
            parts.append(f"""{c}{j} AS (SELECT doc_id, x.lang, leaf, CASE WHEN n > 1 THEN sha256({before} || cur || {after}) ELSE cur END AS cur, i // 8 AS i, proof || {before} || {after} AS proof{', subroot' if c == 'o' else ''}
  FROM {c}{j - 1} x JOIN {r}{j} y ON x.lang IS NOT DISTINCT FROM y.lang AND i // 8 = r)""")

    climb("n", "r", "c", levels)
    parts.append(f"t AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, h, count(*) OVER () AS n FROM n{levels})")
    parts.append("g0 AS (SELECT 0 AS lang, i, h, n FROM t)")
    parts.append(f"o0 AS (SELECT doc_id, 0 AS lang, leaf, cur, t.i, proof, h AS subroot FROM c{levels} x JOIN t ON x.lang IS NOT DISTINCT FROM t.lang)")
    climb("g", "q", "o", outer)
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = h AS verified FROM o{outer}, g{outer}"


MANIFEST = _manifest()


def _codes() -> str:
    distance = "list_sum(list_transform(range(1, w + 1), lambda i: (q[i] - c[i]) * (q[i] - c[i])))"
    parts = [f"""e AS (SELECT *, len(v) // {PARTS} AS w, row_number() OVER () AS rid FROM (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
q AS MATERIALIZED (SELECT rid, p, w, v[p * w + 1 : p * w + w] AS q FROM e, range({PARTS}) t(p)),
s AS (SELECT rid, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS j FROM e),
b0 AS MATERIALIZED (SELECT p, j, q AS c FROM q JOIN s USING (rid) WHERE j < {ENTRIES})"""]
    for k in range(ROUNDS + 1):
        parts.append(f"a{k} AS MATERIALIZED (SELECT rid, p, min({distance} * {ENTRIES} + j) AS m FROM q JOIN b{k} USING (p) GROUP BY rid, p)")
        if k < ROUNDS:
            parts.append(f"u{k} AS (SELECT p, CAST(m % {ENTRIES} AS BIGINT) AS j, i, CAST(sum(q[i]) AS BIGINT) AS s, count(*) AS n FROM q JOIN a{k} USING (rid, p), range(1, 1025) t(i) WHERE i <= w GROUP BY p, m % {ENTRIES}, i)")
            parts.append(f"b{k + 1} AS MATERIALIZED (SELECT p, j, coalesce(f.c, b{k}.c) AS c FROM b{k} LEFT JOIN (SELECT p, j, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM u{k} GROUP BY p, j) f USING (p, j))")
    parts.append(f"r AS (SELECT rid, string_agg(printf('%02x', CAST(m % {ENTRIES} AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(m // {ENTRIES}) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY rid)")
    parts.append("y AS (SELECT *, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error FROM r JOIN e USING (rid))")
    parts.append(f"z AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, j)) AS h FROM b{ROUNDS})")
    return f"WITH {', '.join(parts)} SELECT vec_id, code, error, label_error, h AS codebooks_sha256 FROM y, z"


CODES = _codes()
