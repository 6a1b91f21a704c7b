"""Pieces of the SQL twins (DuckDB dialect)."""

from __future__ import annotations

from sheaf.functions import text as T


def rnd(x: str, places: int) -> str:
    """The library's rounding."""
    return f"(floor(CAST({x} AS DOUBLE) * {10**places} + 0.5000001) / {10**places})"


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def array(words) -> str:
    return "[" + ", ".join(quote(w) for w in words) + "]"


def tokens(c: str, stop_words=T.STOP_WORDS) -> str:
    joined = rf"regexp_replace(lower(coalesce({c}, '')), '([\p{{L}}\p{{N}}_]+)/([\p{{L}}\p{{N}}_]+)', '\1_per_\2', 'g')"
    words = rf"string_split_regex(regexp_replace({joined}, '[^a-z0-9\s_]', ' ', 'g'), '\s+')"
    return f"list_filter({words}, lambda w: length(w) >= 2 AND NOT list_contains({array(stop_words)}, w))"


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def clean(c: str) -> str:
    out = f"coalesce({c}, '')"
    for p in T.NOISE:
        out = f"regexp_replace({out}, {quote('(?im)' + p)}, ' ', 'g')"
    out = rf"regexp_replace({out}, '-\s*\n\s*', '', 'g')"
    out = rf"regexp_replace({out}, '([\p{{L}}\p{{N}}_]+)\s*/\s*([\p{{L}}\p{{N}}_]+)', '\1/\2', 'g')"
    out = rf"regexp_replace(regexp_replace({out}, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"
    for wrong, right in T.LITERALS:
        out = f"replace({out}, {quote(wrong)}, {quote(right)})"
    return strip(out)


def sentences(c: str, least: int = 15) -> str:
    parts = rf"string_split_regex(regexp_replace(coalesce({c}, ''), '([.!?])[ \t\r\n]+', '\1' || chr(10), 'g'), '\n+')"
    return rf"list_filter(list_transform({parts}, lambda s: regexp_replace(s, '^[ \t\r]+|[ \t\r]+$', '', 'g')), lambda s: length(s) > {least})"


def answer_sentences(c: str) -> str:
    parts = rf"string_split(regexp_replace(coalesce({c}, ''), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"
    return f"list_filter(list_transform({parts}, lambda s: {strip('s')}), lambda s: length(s) > 10 AND NOT starts_with(s, '#') AND NOT starts_with(s, '**') AND NOT contains(s, '|'))"


def hard(c: str) -> str:
    s = strip(c)
    return f"(regexp_matches({s}, {quote('(?i)^(' + T.SECTION_HEADERS + ')')}) OR regexp_matches({s}, {quote(T.CAPITALS)}) OR regexp_matches({s}, {quote(T.NUMBERED)}))"


def rows(values) -> str:
    one = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else quote(str(v))
    return ", ".join("(" + ", ".join(one(v) for v in r) + ")" for r in values)


def first_contained(text: str, words, default: str | None = None) -> str:
    cases = " ".join(f"WHEN contains({text}, {quote(w.lower())}) THEN {quote(w)}" for w in words)
    return f"CASE {cases} ELSE {'NULL' if default is None else quote(default)} END" if words else ("NULL" if default is None else quote(default))


def contains_any(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, {quote(w)})" for w in words) + ")"


BM25 = f"""
c AS (SELECT doc_id AS chunk_id, {tokens('text')} AS toks FROM documents),
st AS (SELECT count(*) AS n_docs, avg(len(toks)) AS avgdl FROM c),
po AS (SELECT term, chunk_id, count(*) AS tf, any_value(dl) AS dl FROM (SELECT chunk_id, len(toks) AS dl, unnest(toks) AS term FROM c) GROUP BY term, chunk_id),
ra AS (SELECT term, df, ln(n_docs - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT term, count(*) AS df FROM po GROUP BY term), st),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM ra) ELSE raw END AS idf FROM ra)"""


def sparse(k: int, stop_words=T.STOP_WORDS) -> str:
    return f"""{BM25},
qt AS (SELECT query_id, term, count(*) AS qf FROM (SELECT item_id AS query_id, unnest({tokens('text', stop_words)}) AS term FROM benchmark) GROUP BY query_id, term),
sc AS (SELECT query_id, chunk_id, sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS raw FROM qt JOIN idf USING (term) JOIN po USING (term), st GROUP BY query_id, chunk_id),
sp AS (SELECT query_id, chunk_id, {rnd('raw / CASE WHEN best > 0 THEN best ELSE 1.0 END', 4)} AS sparse_score FROM (SELECT *, max(raw) OVER (PARTITION BY query_id) AS best FROM sc) WHERE raw > 0),
sparse AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sparse_score DESC, chunk_id) AS sparse_rank FROM sp) WHERE sparse_rank <= {k})"""


def dense(k: int) -> str:
    return f"""
dn AS (SELECT b.item_id AS query_id, e.vec_id AS chunk_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 4) AS dense_score
       FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id, embeddings e),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dense_score DESC, chunk_id) AS dense_rank FROM dn) WHERE dense_rank <= {k})"""


MERGED = """
me AS (SELECT coalesce(d.query_id, s.query_id) AS query_id, coalesce(d.chunk_id, s.chunk_id) AS chunk_id, coalesce(dense_score, 0.0) AS dense_score,
       coalesce(sparse_score, 0.0) AS sparse_score, dense_rank, sparse_rank FROM dense d FULL JOIN sparse s ON d.query_id = s.query_id AND d.chunk_id = s.chunk_id)"""
FOUND_BY = "concat_ws('+', CASE WHEN dense_rank IS NOT NULL THEN 'dense' END, CASE WHEN sparse_rank IS NOT NULL THEN 'sparse' END)"
