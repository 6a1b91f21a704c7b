"""Sources and sinks of the ingest: files, extracted documents, chunk and vector stores, scraped links."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheaf import schemas
from sheaf.functions.text import clean_text
from sheaf.session import ship

from . import files as fs
from . import keyed


def scan_files(spark: SparkSession, folder: str, pattern: str = "*.[pP][dD][fF]") -> DataFrame:
    """``path, modificationTime, length, content, filename`` of a folder's files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).withColumn("filename", F.element_at(F.split("path", "/"), -1))


def new_files(files: DataFrame, done: DataFrame, key: str = "filename") -> DataFrame:
    return files.join(done.select(key), key, "left_anti")


def extract_documents(files: DataFrame, extractors: list[Callable[[bytes], list[dict]]] | None = None, ocr: Callable[[bytes, int], str] | None = None) -> DataFrame:
    """Pages of each file by the first extractor that succeeds; none: no pages. Pages without text go to ``ocr``, whose failure gives the empty text. Without extractors: ``simple_pdf``, then ``plain_text``."""
    ship(files.sparkSession)
    extractors = [simple_pdf, plain_text] if extractors is None else extractors

    def run(batches: Iterator):
        for pdf in batches:
            rows = []
            for name, content in zip(pdf["filename"], pdf["content"], strict=True):
                pages: list[dict] = []
                for extract in extractors:
                    try:
                        pages = extract(content)
                        break
                    except Exception:  # noqa: BLE001  a provider's failure passes the file to the next one
                        continue
                for p in pages:
                    if ocr and not (p.get("text") or "").strip():
                        try:
                            p["text"] = ocr(content, p["page_number"])
                        except Exception:  # noqa: BLE001
                            p["text"] = ""
                rows.append({"filename": name, "pages": [{"page_number": p["page_number"], "text": p.get("text") or "", "tables_text": p.get("tables_text") or []} for p in pages], "total_pages": len(pages)})
            import pandas as pd

            yield pd.DataFrame(rows, columns=["filename", "pages", "total_pages"])

    return files.select("filename", "content").mapInPandas(run, schemas.EXTRACTED)


def write_extracted(docs: DataFrame, path: str, mode: str = "append") -> None:
    docs.write.mode(mode).json(path)


def read_extracted(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """Extracted documents, one JSON text a file. Files that are no UTF-8 are read as Latin-1; ``encoding`` fixes one for all."""
    if encoding:
        return spark.read.schema(schemas.EXTRACTED).option("encoding", encoding).option("multiLine", True).json(path)
    files = spark.read.format("binaryFile").load(path).select("content")
    text = F.coalesce(F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")), F.decode("content", "ISO-8859-1"))
    return files.select(F.from_json(text, schemas.EXTRACTED).alias("d")).select("d.*").where(F.col("filename").isNotNull())


def plain_text(content: bytes) -> list[dict]:
    """An extractor for text files: pages end at form feeds."""
    return [{"page_number": i + 1, "text": t, "tables_text": []} for i, t in enumerate(content.decode("utf-8").split("\f"))]


_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.S)
_SHOWN = re.compile(rb"\((?:\\.|[^\\()])*\)\s*Tj|\[(?:[^\[\]\\]|\\.)*\]\s*TJ|T\*|\bTd\b|\bTD\b", re.S)
_STRING = re.compile(rb"\(((?:\\.|[^\\()])*)\)", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t"}


def simple_pdf(content: bytes) -> list[dict]:
    """A small PDF extractor without a library: literal strings that content streams show (plain or deflated, one-byte encodings), one page a stream.

    It knows no fonts' own encodings, no hexadecimal strings and no reading order; a better extractor goes in front of it. Raises where it finds no text.
    """
    if not content.startswith(b"%PDF"):
        raise ValueError("no PDF")
    pages = []
    for m in _STREAM.finditer(content):
        data = m[1]
        try:
            data = zlib.decompress(data)
        except zlib.error:
            pass
        if b"BT" not in data:
            continue
        out = []
        for part in _SHOWN.findall(data):
            if part[:1] in b"([":
                out.append(b"".join(re.sub(rb"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), x, flags=re.S) for x in _STRING.findall(part)).decode("latin-1"))
            else:
                out.append("\n")
        text = "".join(out).strip("\n")
        if text:
            pages.append({"page_number": len(pages) + 1, "text": text, "tables_text": []})
    if not pages:
        raise ValueError("no text")
    return pages


def pages_of(docs: DataFrame) -> DataFrame:
    return docs.select("filename", F.explode("pages").alias("p")).select("filename", "p.*")


def clean_pages(pages: DataFrame) -> DataFrame:
    return pages.withColumn("chars_before", F.length(F.coalesce("text", F.lit("")))).withColumn("text", clean_text(F.col("text"))).withColumn("tables_text", F.transform("tables_text", lambda x: clean_text(x))).withColumn("chars_after", F.length("text"))


def cleaning_stats(pages: DataFrame, by: str = "filename") -> DataFrame:
    """Characters before and after of each document and the share removed (tables are cleaned, not counted)."""
    before, after = F.sum("chars_before"), F.sum("chars_after")
    return pages.groupBy(by).agg(before.alias("chars_before"), after.alias("chars_after"), (before - after).alias("chars_removed"), F.round((before - after) / F.greatest(before, F.lit(1)) * 100, 1).alias("reduction_pct"))


#: Buckets of a chunk store, the same for all its batches.
CHUNK_BUCKETS = 64


def append_chunks(new: DataFrame, path: str, by: str = "chunk_id", buckets: int = CHUNK_BUCKETS) -> int:
    """Append chunks whose id the store lacks (existing rows stay; repeats inside the batch are not touched); a missing or empty store is created. Returns the rows added.

    The store is a table by bucket, a hash of ``by``: ids are looked up in the batch's buckets and in no others, and only what is new is written. ``by``: the id, or a column that
    the id determines (the source, where ids are made from it), which keeps the chunks of a file in one bucket; always the same for a store.
    """
    spark = new.sparkSession
    held = new.withColumn("_bucket", F.pmod(F.xxhash64(by), F.lit(buckets)).cast("int")).persist()
    known = table_exists(spark, path)
    try:
        fresh = held
        if known:
            touched = [r[0] for r in held.select("_bucket").distinct().collect()]  # a number a bucket at most
            stored = spark.read.parquet(path).where(F.col("_bucket").isin(touched)).select("chunk_id")
            fresh = held.join(stored, "chunk_id", "left_anti").persist()
        n = fresh.count()
        if n or not known:
            fresh.hint("rebalance", "_bucket").sortWithinPartitions("_bucket", "chunk_id").write.mode("append").partitionBy("_bucket").parquet(path)
        fresh.unpersist()
        return n
    finally:
        held.unpersist()


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder holds a readable Parquet table, asked through Spark's own file system."""
    return any(n.startswith("part-") or ("=" in n and n[0] != ".") for n in fs.names(spark, path))


def export_vectors(store: DataFrame) -> DataFrame:
    """Chunks back from vector records: defaults, tags split on commas, trimmed, without empty ones."""
    tags = F.filter(F.transform(F.split(F.coalesce("crop_tags", F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return store.select("chunk_id", "text", F.coalesce("char_count", F.lit(0)).alias("char_count"), "source_file", F.coalesce("authority_score", F.lit(0.5)).alias("authority_score"), F.coalesce("trust_weight", F.lit(1.0)).alias("trust_weight"), tags.alias("crop_tags"))


def migrate_json(spark: SparkSession, source: str, target: str, backup: str | None = None, lines: bool = False) -> None:
    """JSON chunks (an array a file, or one a line) to Parquet; an existing target is refused. ``backup``: where the source is moved once the target is written."""
    spark.read.schema(schemas.CHUNK).option("multiLine", not lines).json(source).write.mode("errorifexists").parquet(target)
    if backup:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(source)
        if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(p, jvm.org.apache.hadoop.fs.Path(backup)):
            raise OSError(f"{source} could not be moved to {backup}")


# One step of reading markup: a comment, a script or style element as a whole, or an anchor with its attributes and body. What comes first is read first, so an anchor
# inside a comment or a script is none, nor is a comment inside a quoted attribute. An open end runs to the end of the page.
_TOKEN = r"""(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)|<a(\s(?:[^>"']|"[^"]*"|'[^']*')*)>(.*?)</a\s*>"""
_HREF = r"""(?is)^(?:[^"'=]|=\s*"[^"]*"|=\s*'[^']*'|=[^\s"'])*?\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
#: Named characters, the ampersand last, so that what it brings is not read again.
_NAMED = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def decoded(text: Column) -> Column:
    """Character references as characters: numbers in decimal and hexadecimal, and the common names; others stay."""

    def piece(x: Column) -> Column:
        ten, six = F.regexp_extract(x, r"^#([0-9]{1,7});", 1), F.regexp_extract(x, r"^#[xX]([0-9a-fA-F]{1,6});", 1)
        code = F.when(ten != "", ten.cast("int")).otherwise(F.conv(six, 16, 10).cast("int"))
        valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        # no ampersand comes of a number here, so the names below are those of the page
        own = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when(valid & (code != 38), F.concat(own, F.regexp_replace(x, r"^#[xX]?[0-9a-fA-F]+;", ""))).when(code == 38, F.concat(F.lit("&amp;"), F.regexp_replace(x, r"^#[xX]?[0-9a-fA-F]+;", ""))).otherwise(F.concat(F.lit("&"), x))

    parts = F.split(text, "&", -1)
    out = F.when(F.contains(text, F.lit("&#")), F.concat(F.get(parts, 0), F.array_join(F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), piece), ""))).otherwise(text)
    for name, character in _NAMED:
        out = F.replace(out, F.lit(name), F.lit(character))
    return out


def links(pages: DataFrame, suffix: str = ".pdf", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id, idx, link, title`` of anchors whose address contains ``suffix``: absolute, with a title longer than three (an empty one reads "Untitled"); ``idx`` counts a page's anchors with an address.

    Addresses may be quoted either way or not at all, character references are decoded, comments and scripts hold no anchors.
    """
    html = F.coalesce(html_col, F.lit(""))
    tokens = F.arrays_zip(F.regexp_extract_all(html, F.lit(_TOKEN), F.lit(1)).alias("attributes"), F.regexp_extract_all(html, F.lit(_TOKEN), F.lit(2)).alias("body"))
    one = lambda x, k: F.regexp_extract(x, _HREF, k)
    read = F.transform(F.filter(tokens, lambda t: t["attributes"].rlike(_HREF)), lambda t: F.struct(decoded(F.concat(one(t["attributes"], 1), one(t["attributes"], 2), one(t["attributes"], 3))).alias("href"), t["body"].alias("body")))
    rows = pages.select(id_col, F.col(url_col).alias("_url"), F.posexplode(read).alias("idx", "a"))
    title = F.regexp_replace(decoded(F.regexp_replace("a.body", r"(?s)<!--.*?-->|<[^>]*>", "")), r"^\s+|\s+$", "")
    base = F.regexp_extract("_url", r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_replace("_url", r"[?#].*$", ""), r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)$", "$1/")
    relative = resolved(F.concat(F.regexp_replace(folder, r"[^/]*$", ""), F.col("a.href")))
    full = F.when(F.col("a.href").startswith("http"), F.col("a.href")).when(F.col("a.href").startswith("/"), F.concat(base, F.col("a.href"))).otherwise(relative)
    out = rows.where(F.contains(F.lower("a.href"), F.lit(suffix.lower()))).select(id_col, "idx", full.alias("link"), F.when(title == "", "Untitled").otherwise(title).alias("title"))
    return out.where(F.length("title") > 3)


def resolved(address: Column) -> Column:
    """An absolute address without ``.`` and ``..`` steps; steps above the root go."""
    base = F.regexp_extract(address, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(address, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    tail = F.regexp_extract(address, r"([?#].*)$", 1)
    steps = F.filter(F.split(F.regexp_replace(path, r"/\.{1,2}$", "$0/"), "/"), lambda x: x != ".")
    kept = F.aggregate(steps, F.array().cast("array<string>"), lambda s, x: F.when(x == "..", F.when(F.size(s) > 1, F.slice(s, F.lit(1), F.size(s) - 1)).otherwise(s)).otherwise(F.concat(s, F.array(x))))
    return F.when(F.contains(path, F.lit("/.")), F.concat(base, F.array_join(kept, "/"), tail)).otherwise(address)


def download(links: DataFrame, path: str, fetch: Callable[[str], tuple[str, bytes]]) -> DataFrame:
    """``links' columns, ok, path``: files fetched from ``link`` into a stored table under ``filename``, in which ``path`` finds them.

    The table is one by key (``keyed``) on any file system that Spark reaches: what a job fetched is committed as a whole, a job that fails leaves nothing. A file that is there is
    not fetched again, a name that several links have is fetched once (from the least link); one of the wrong type is not kept, a fetch that fails
    leaves no row. ``fetch(link) -> (content type, bytes)``.
    """
    spark = links.sparkSession
    ship(spark)
    known = keyed.read(spark, path, _FILE).select("filename")
    wanted = links.groupBy("filename").agg(F.min("link").alias("link")).where(F.col("link").isNotNull() & F.col("filename").isNotNull()).join(known, "filename", "left_anti")

    def run(batches: Iterator):
        import pandas as pd

        for pdf in batches:
            rows = []
            for name, link in zip(pdf["filename"], pdf["link"], strict=True):
                try:
                    kind, data = fetch(link)
                except Exception:  # noqa: BLE001  a failing download must not fail the batch
                    continue
                if "pdf" in (kind or "").lower() or link.lower().endswith(".pdf"):
                    rows.append((name, link, bytes(data), len(data)))
            yield pd.DataFrame(rows, columns=["filename", "link", "content", "length"])

    keyed.append(wanted.repartition("filename").mapInPandas(run, _FILE), path, ["filename"])
    held = keyed.read(spark, path, _FILE).select(F.col("filename").alias("_name"))
    return links.join(held, F.col("filename") == F.col("_name"), "left").select(*links.columns, F.col("_name").isNotNull().alias("ok"), F.when(F.col("_name").isNotNull(), F.concat(F.lit(f"{path}#"), "_name")).alias("path"))


_FILE = "filename string, link string, content binary, length long"


def downloaded(spark: SparkSession, path: str) -> DataFrame:
    """``filename, link, content, length`` of the files that ``download`` stored, for ``extract_documents``."""
    return keyed.read(spark, path, _FILE)


def cap_per_source(downloads: DataFrame, by: str, order: str | list[str], most: int) -> DataFrame:
    """The first ``most`` successful downloads of each source."""
    order = [order] if isinstance(order, str) else order
    return downloads.where("ok").withColumn("_k", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_k") <= most).drop("_k")


def wanted_download(content_type: Column, url: Column) -> Column:
    return F.contains(F.lower(F.coalesce(content_type, F.lit(""))), F.lit("pdf")) | F.lower(url).endswith(".pdf")


def safe_filename(title: Column, source: Column, index: Column) -> Column:
    """``Source_title_3.pdf``: unsafe characters as underscores, sixty of them, blanks as underscores."""
    safe = F.substring(F.regexp_replace(title, r"[^\p{L}\p{N} _-]", "_"), 1, 60)
    return F.concat(F.get(F.split(source, r"\s+"), 0), F.lit("_"), F.replace(F.trim(safe), F.lit(" "), F.lit("_")), F.lit("_"), index.cast("string"), F.lit(".pdf"))


def line_kinds(text: Column) -> Column:
    """``array<struct(line, kind)>`` of a Markdown text: code, fence, h1 to h6, rule, blank, paragraph. A line is code while the fences above it are odd.

    Lines between two fences are classified together, so every line is looked at once.
    """
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)

    def plain(x: Column) -> Column:
        return (
            F.when(F.regexp_like(x, F.lit(r"^#{1,6} ")), F.concat(F.lit("h"), F.length(F.regexp_extract(x, r"^(#{1,6}) ", 1)).cast("string")))
            .when(F.regexp_like(F.trim(x), F.lit(r"^(---+|\*\*\*+|___+)$")), "rule")
            .when(F.trim(x) == "", "blank").otherwise("paragraph"))

    def classify(all_lines: Column) -> Column:
        fences = F.filter(F.sequence(F.lit(0), F.size(all_lines) - 1), lambda i: F.trim(F.get(all_lines, i)).startswith("```"))

        def parts(at: Column) -> Column:
            row = lambda x, kind: F.struct(x.alias("line"), kind.alias("kind"))
            head = F.transform(F.slice(all_lines, F.lit(1), F.coalesce(F.get(at, 0), F.size(all_lines))), lambda x: row(x, plain(x)))
            rest = F.transform(at, lambda a, k: F.concat(
                F.array(row(F.get(all_lines, a), F.lit("fence"))),
                F.transform(F.slice(all_lines, a + 2, F.coalesce(F.get(at, k + 1), F.size(all_lines)) - a - 1), lambda x: row(x, F.when(k % 2 == 0, "code").otherwise(plain(x))))))
            return F.concat(head, F.flatten(rest))

        return F.element_at(F.transform(F.array(fences), parts), 1)

    return F.element_at(F.transform(F.array(lines), classify), 1)


def inline_markdown(line: Column) -> Column:
    """Bold and italic marks as tags: ``**x**`` to ``<b>x</b>``, then ``*x*`` to ``<i>x</i>``."""
    return F.regexp_replace(F.regexp_replace(line, r"\*\*(.+?)\*\*", "<b>$1</b>"), r"\*(.+?)\*", "<i>$1</i>")
