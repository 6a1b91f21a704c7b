"""Files, stores and graphs written and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheaf.operators import graph, providers, trust
from sheaf.sources import documents as S
from sheaf.sources import stores, vectors

from . import sql as Q
from .graph_queries import USABLE, triplets
from .registry import query, scratch_folder, table, texts


@query("scan_extract", "SELECT 'f' || page_id || CASE WHEN page_id % 2 = 0 THEN '.pdf' ELSE '.PDF' END AS filename, 1 AS total_pages, html AS text FROM pages WHERE page_id % 3 > 0")
def scan_extract(spark, d):
    """Pages as files of a folder, found by their suffix and extracted by the first extractor that can."""
    path = scratch_folder(spark)
    p, i = texts(spark, d, "pages"), F.col("page_id")
    name = F.concat(F.lit("f"), i.cast("string"), F.when(i % 3 == 0, ".txt").when(i % 2 == 0, ".pdf").otherwise(".PDF"))
    _as_files(p.select(name.alias("name"), F.col("html").alias("body")), path)
    out = S.extract_documents(S.scan_files(spark, path), [S.simple_pdf, S.plain_text])
    return out.select("filename", "total_pages", F.get("pages", 0)["text"].alias("text"))


def _as_files(rows, path: str) -> None:
    """A file of its own for each row ``(name, body)``, in the folder that all tasks see."""
    folder = path.removeprefix("file://").removeprefix("file:")

    def run(batches):
        import os

        os.makedirs(folder, exist_ok=True)
        for pdf in batches:
            for name, body in zip(pdf["name"], pdf["body"], strict=True):
                with open(f"{folder}/{name}", "wb") as f:
                    f.write(bytes(body) if isinstance(body, (bytes, bytearray)) else (body or "").encode())
            yield pdf[["name"]]

    rows.mapInPandas(run, "name string").write.format("noop").mode("overwrite").save()


@query("extracted_round_trip", "SELECT 'doc' || item_id || '.json' AS filename, 2 AS total_pages, text || ' é' AS first, 'ü' AS second FROM benchmark")
def extracted_round_trip(spark, d):
    """Extracted documents as JSON files, a third of them in Latin-1, read back."""
    path, i = scratch_folder(spark), F.col("item_id")
    page = lambda n, t: F.struct(F.lit(n).alias("page_number"), t.alias("text"), F.array().cast("array<string>").alias("tables_text"))
    docs = table(spark, d, "benchmark").select("item_id", F.concat(F.lit("doc"), i.cast("string"), F.lit(".json")).alias("filename"), F.array(page(1, F.concat("text", F.lit(" é"))), page(2, F.lit("ü"))).alias("pages"), F.lit(2).alias("total_pages"))
    text = F.to_json(F.struct("filename", "pages", "total_pages"))
    _as_files(docs.select(F.col("filename").alias("name"), F.when(i % 3 == 0, F.encode(text, "ISO-8859-1")).otherwise(F.encode(text, "UTF-8")).alias("body")), path)
    return S.read_extracted(spark, path).select("filename", "total_pages", F.get("pages", 0)["text"].alias("first"), F.get("pages", 1)["text"].alias("second"))


@query("json_to_parquet", "SELECT 'chunk_' || item_id AS chunk_id, text, length(text) AS char_count FROM benchmark")
def json_to_parquet(spark, d):
    """JSON chunks migrated; the source is moved to its backup."""
    path = scratch_folder(spark)
    table(spark, d, "benchmark").select(F.concat(F.lit("chunk_"), "item_id").alias("chunk_id"), "text", F.length("text").alias("char_count")).write.json(f"{path}/chunks")
    S.migrate_json(spark, f"{path}/chunks", f"{path}/parquet", f"{path}/chunks_backup", lines=True)
    return spark.read.parquet(f"{path}/parquet").select("chunk_id", "text", "char_count")


@query("vector_upsert", "SELECT doc_id AS chunk_id, 'a, b' AS crop_tags, n_chars AS char_count, 64 AS dims FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def vector_upsert(spark, d):
    """Documents are put into a store that has some of them: the records that were written the second time."""
    path = scratch_folder(spark)
    chunks = texts(spark, d).select(
        F.col("doc_id").alias("chunk_id"), "text", F.array(F.lit("a"), F.lit("b")).alias("crop_tags"), F.col("source").alias("source_file"), F.lit(1.0).alias("trust_weight"), F.col("n_chars").alias("char_count"),
        F.lit(0.8).alias("authority_score"), F.lit(0.0).alias("bias_penalty"), F.lit(2023).alias("year"))
    stored = chunks.join(table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id")), "chunk_id", "left_semi")
    vectors.upsert(stored, path, providers.hashed_embedding)
    return vectors.upsert(chunks, path, providers.hashed_embedding).select("chunk_id", "crop_tags", "char_count", F.size("embedding").alias("dims"))


@query("graph_store", f"""WITH {USABLE}, no AS (SELECT node, count(*) AS n FROM (SELECT subject AS node FROM ok UNION ALL SELECT object FROM ok) GROUP BY node)
SELECT (SELECT count(*) FROM lineitem) AS triplets, (SELECT count(*) FROM no) AS nodes, (SELECT CAST(sum(n) AS BIGINT) FROM no) AS mentions, (SELECT count(*) FROM ed) AS edges""")
def graph_store(spark, d):
    """The graph written and loaded."""
    path = scratch_folder(spark)
    stores.write_graph(triplets(spark, d), path)
    n = lambda name, what=None: spark.read.parquet(f"{path}/{name}").select((what if what is not None else F.count("*")).alias("n")).scalar()
    return spark.range(1).select(n("triplets").alias("triplets"), n("nodes").alias("nodes"), n("nodes", F.sum("mentions")).alias("mentions"), n("edges").alias("edges"))


_FACTS = """WITH c AS (SELECT doc_id, source, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS k, greatest(1, count(*) OVER (PARTITION BY source) // 20) AS s FROM documents),
f AS (SELECT doc_id, lower(regexp_extract(m, '^[^ ]+')) AS subject, lower(regexp_extract(m, '[^ ]+$')) AS object FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_]+ that [\\p{L}\\p{N}_]+')) AS m FROM c WHERE k % s = 0 AND k // s < 20))"""


@query("graph_build", f"{_FACTS} SELECT DISTINCT subject, 'that' AS relationship, object FROM f")
def graph_build(spark, d):
    """Facts of whole texts of an even sample of each source, in two batches and a third that finds nothing left to ask."""
    path = scratch_folder(spark)
    chunks = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), "doc_id", F.col("source").alias("source_file"), "text")
    for part in (chunks.where("doc_id % 2 = 0"), chunks, chunks):
        stores.build_graph(part if part is chunks else _even(chunks, part), path, _that, 20, order="doc_id")
    return spark.read.parquet(f"{path}/edges").select("subject", "relationship", "object")


def _even(chunks, part):
    """The rows of ``part`` that are in the sample of all."""
    return graph.even_sample(chunks, "source_file", "doc_id", 20).join(part.select("chunk_id"), "chunk_id", "left_semi")


def _that(chunks):
    found = F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+ that [\p{L}\p{N}_]+"), F.lit(0))
    rows = chunks.select("chunk_id", "source_file", F.substring("text", 1, 200).alias("chunk_text"), F.explode(found).alias("m"))
    return rows.select(F.split("m", " that ")[0].alias("subject"), F.lit("that").alias("relationship"), F.split("m", " that ")[1].alias("object"), F.lit(0.9).alias("confidence"), "source_file", "chunk_text", "chunk_id")


@query("gate_log_append", "SELECT event_type AS stage, CAST(2 * count(*) AS BIGINT) AS n, true AS stamped FROM events GROUP BY event_type")
def gate_log_append(spark, d):
    """A log appended to twice; rows without a time get one."""
    path = scratch_folder(spark)
    rows = table(spark, d, "events").select(F.col("event_type").alias("stage"), F.when(F.col("event_id") % 2 == 0, F.col("ts")).alias("ts"))
    for _ in range(2):
        stores.append_log(rows, path)
    return stores.read_table(spark, path, "stage string, ts timestamp").groupBy("stage").agg(F.count("*").alias("n"), F.bool_and(F.col("ts").isNotNull()).alias("stamped"))


@query("sampled_consistency", f"""WITH r AS (SELECT doc_id, {Q.rnd('(doc_id * 37 % 1009) / 1009', 4)} AS ra FROM documents) SELECT doc_id AS chunk_id, CASE doc_id % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.8::DOUBLE ELSE 0.6::DOUBLE END AS mscp_score FROM r WHERE ra >= 0.35 AND doc_id % 7 <> 6""")
def sampled_consistency(spark, d):
    """Five answers a chunk that is worth it: alike, one apart, two apart from each other; some chunks get none."""
    from sheaf.functions.numbers import rounded

    r = table(spark, d, "documents").select(F.lit("q").alias("query_id"), F.col("doc_id").alias("chunk_id"), F.lit("?").alias("query"), F.lit("").alias("text"), rounded((F.col("doc_id") * 37 % 1009) / 1009, 4).alias("ra_score"))
    other = lambda s: F.when((s == 4) & (F.col("chunk_id") % 3 > 0), "one").when((s == 3) & (F.col("chunk_id") % 3 == 2), "two").otherwise("same")

    def sample(rows, n):
        said = rows.select("query_id", "chunk_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("sample"))
        return said.withColumn("answer", F.when(F.col("chunk_id") % 7 < 6, other(F.col("sample"))))

    embed = lambda a: F.when(a == "one", F.array(F.lit(1.0), F.lit(0.0))).when(a == "two", F.array(F.lit(0.0), F.lit(1.0))).otherwise(F.array(F.lit(-1.0), F.lit(-1.0)))
    return trust.sampled_consistency(r, sample, embed).select("chunk_id", "mscp_score")


@query("weather_prepend", "SELECT source AS query_id, string_agg(chunk || ':' || place, ',' ORDER BY place) AS chunks FROM (SELECT source, CAST(doc_id AS VARCHAR) AS chunk, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents UNION ALL SELECT DISTINCT source, 'weather', 0 FROM documents WHERE source <> 'src1') WHERE place <= 2 GROUP BY source")
def weather_prepend(spark, d):
    """Weather in front of each source's documents but one's."""
    docs = table(spark, d, "documents").select(F.col("source").alias("query_id"), F.col("doc_id").alias("chunk_id"), F.lit("").alias("text"), F.col("source").alias("source_file"), F.lit(0.5).alias("final_score"))
    said = docs.select("query_id").distinct().where("query_id <> 'src1'").withColumn("text", F.lit("rain"))
    out = providers.prepend_weather(providers.renumber(docs, ["chunk_id"]), said).where("chunk_rank <= 2")
    rows = F.sort_array(F.collect_list(F.struct("chunk_rank", F.concat("chunk_id", F.lit(":"), F.col("chunk_rank").cast("string")).alias("t"))))
    return out.groupBy("query_id").agg(F.array_join(F.transform(rows, lambda x: x["t"]), ",").alias("chunks"))


@query("downloads", "SELECT page_id, page_id % 4 <> 1 AS ok, CASE WHEN page_id % 4 <> 1 THEN strlen(html) END AS length FROM pages")
def downloads(spark, d):
    """Pages fetched twice from a service that fails at times and sends another type at times, and would fail the second time."""
    path, i = scratch_folder(spark), F.col("page_id")
    served = texts(spark, d, "pages").select("page_id", F.concat(F.lit("http://x/"), i.cast("string"), F.when(i % 4 == 2, ".pdf").otherwise("")).alias("link"), F.concat(F.lit("f"), i.cast("string")).alias("filename"), "html")
    rows = served.select("page_id", "filename", F.concat("link", F.lit("?"), F.octet_length("html").cast("string"), F.when(i % 4 == 2, ".pdf").otherwise("")).alias("link"))

    def fetch(link):
        n, size = (int(x.removesuffix(".pdf")) for x in link.rsplit("/", 1)[1].split("?"))
        if n % 4 == 1:
            raise OSError("no answer")
        return ("application/pdf" if n % 4 != 2 else "text/html"), b"x" * size

    def never(link):
        raise OSError("no answer")

    S.download(rows, path, fetch)
    again = S.download(rows, path, never)
    return again.join(S.downloaded(spark, path).select("filename", "length"), "filename", "left").select("page_id", "ok", "length")


@query("call_ledger", "SELECT item_id, md5(text) AS reply FROM benchmark")
def call_ledger(spark, d):
    """A service asked for every text in a first run; a second run asks again and gets what is remembered, its own service would answer otherwise."""
    import hashlib

    from sheaf.sources import ledger

    path = scratch_folder(spark)
    rows = table(spark, d, "benchmark")
    ledger.replies(rows, path, lambda t: hashlib.md5(t.encode()).hexdigest(), request="text")
    return ledger.replies(rows, path, str.lower, request="text").select("item_id", "reply")


@query("search_settings", "SELECT source AS name, 0.6::DOUBLE AS dense_weight, 0.4::DOUBLE AS sparse_weight, 60 AS rrf_k, CAST(count(*) AS INTEGER) AS top_k FROM documents GROUP BY source")
def search_settings(spark, d):
    """Settings of each source, with as many results as it has documents, stored as JSON and loaded."""
    path = f"{scratch_folder(spark)}/settings"
    rows = table(spark, d, "documents").groupBy(F.col("source").alias("name")).agg(F.count("*").cast("int").alias("top_k"))
    stores.write_settings(rows, path)
    return stores.read_settings(spark, path)


@query("inline_markdown", r"SELECT doc_id, regexp_replace(regexp_replace('**' || source || '** and *' || lang || '* or ** x', '\*\*(.+?)\*\*', '<b>\1</b>', 'g'), '\*(.+?)\*', '<i>\1</i>', 'g') AS line FROM documents")
def inline_markdown(spark, d):
    return table(spark, d, "documents").select("doc_id", S.inline_markdown(F.concat(F.lit("**"), "source", F.lit("** and *"), "lang", F.lit("* or ** x"))).alias("line"))
