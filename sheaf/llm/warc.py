"""WARC archives: write, and read back with boundary-chain verification.

Writing renders records with expressions and lets Spark's text sink lay them down as they are (a record's last line feed is
the sink's line separator), at most ``RECORDS_A_FILE`` in a file. Reading deals the byte ranges (blocks) of archives of any size to
tasks: Spark's text source, split at the version magic, hands a task the pieces that begin in its block. Tasks
emit each well-formed candidate as an edge from its offset to its successor's; a record whose payload or header holds
magic is put together from its pieces. Offsets in a file are the sums of the blocks before. Pointer jumping inside
a block leads every candidate to where its chain leaves the block; over blocks, joins from offset 0 double the reach each
round; the records on the chain are kept, magic inside payloads starts no record on it and is rejected.

Headers may have any length. Where a record that holds magic crosses the end of a block, or a chain does not end at the file's length, that
file is read once more as a whole (as a ``binaryFile``, 2 GB at most), and a chain that still breaks raises an error.

Defined results: a null page body is the empty payload; a null url leaves the target out, control characters and
blanks of a url are written as %20; a null page id is written as ``none``, reads back as null and is never the response that
others refer to unless all ids of the group are null (then all are responses); rows that repeat the least page id are
all responses; an empty table gives no archive and an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import urllib.parse
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_batches, materialize, shared_folder

LEAST_REVISIT = 100
RECORDS_A_FILE = 5000
DATE = "2024-01-01T00:00:00Z"
MAGIC = b"WARC/1."
_MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
SCHEMA = "file string, offset bigint, successor bigint, record_type string, record_id string, refers_to string, payload_bytes bigint, payload_digest string"


def plan_records(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """``id, url, body, digest, record_type, refers_to``: equal payloads of at least ``LEAST_REVISIT`` bytes are kept once."""
    body = F.coalesce(F.col(body_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), body.alias("body"), F.sha2(body.cast("binary"), 256).alias("digest"))
    # Written first, so that its size is known when the join is planned: a small one is broadcast and pages stay where they are.
    shared = materialize(
        rows.where(F.octet_length("body") >= LEAST_REVISIT).groupBy("digest").agg(F.count("*").alias("n"), F.min("id").alias("first")).where(F.col("n") > 1).select("digest", "first"),
        "shared-payloads",
    )
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    return rows.join(shared, "digest", "left").select(
        "id", "url", "body", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"))


def render(records: DataFrame) -> DataFrame:
    """One string a record, without its last line feed."""
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    line = lambda key, value: F.coalesce(F.concat(F.lit(key + ": "), value, F.lit("\r\n")), F.lit(""))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("body").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(F.col("record_type") == "revisit", F.lit("")).otherwise(F.concat(http, F.col("body")))
    return records.withColumn("_block", block).select(F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", name("id")),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")),
        line("WARC-Refers-To", F.when(F.col("record_type") == "revisit", name("refers_to"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length("_block").cast("string")),
        F.lit("\r\n"), F.col("_block"), F.lit("\r\n\r"),
    ).alias("value"))


def write_archives(pages: DataFrame, path: str, **columns: str) -> None:
    render(plan_records(pages, **columns)).write.option("lineSep", "\n").option("maxRecordsPerFile", RECORDS_A_FILE).option("compression", "none").text(path)


def header_fields(data, starts: list[int], end: int) -> Iterator[tuple[int, dict]]:
    """Fields of headers that all end at ``end``, the last one first; a header takes in those that begin after it, so each line is parsed once."""
    fields, upto = {}, end
    for at in reversed(starts):
        begin = at + len(MAGIC) + 3
        for row in reversed(bytes(data[begin : max(begin, upto)]).split(b"\r\n")):
            key, colon, value = row.partition(b":")
            if colon:
                fields.setdefault(key.strip().lower(), value.strip())
        upto = begin
        yield at, fields.copy()


def block_length(fields: dict) -> int | None:
    found = fields.get(b"content-length", b"").decode("utf-8", "replace")
    return int(found) if found.isascii() and found.isdigit() else None


def described(fields: dict, block: bytes) -> tuple:
    """Type, id, refers to, payload bytes and digest of a record with this block."""
    text = lambda k: None if (v := fields.get(k)) is None else v.decode("utf-8", "replace")
    kind = text(b"warc-type") or ""
    if kind == "revisit":
        return kind, text(b"warc-record-id"), text(b"warc-refers-to"), None, (text(b"warc-payload-digest") or "").removeprefix("sha256:")
    split = block.find(b"\r\n\r\n") if block[:5] == b"HTTP/" else -1
    payload = memoryview(block)[split + 4 if split >= 0 else 0 :]
    return kind, text(b"warc-record-id"), text(b"warc-refers-to"), len(payload), hashlib.sha256(payload).hexdigest()


def candidates(data: bytes) -> list[tuple]:
    """Offset, successor, type, id, refers to, payload bytes and digest of what may be a record of a whole archive."""
    out, group, end = [], [], -1

    def close() -> None:
        block = None
        for at, fields in reversed(list(header_fields(data, group, end))):
            n = block_length(fields)
            if n is None:
                continue
            stop = end + 4 + n
            following = stop + 4
            if data[stop:following] != b"\r\n\r\n" or following < len(data) and not data.startswith(MAGIC, following):
                continue
            if block is None or len(block) != n:
                block = data[end + 4 : stop]
            out.append((at, following, *described(fields, block)))

    for m in _MAGIC.finditer(data):
        if m.start() > end:
            if group:
                close()
            group = []
            end = data.find(b"\r\n\r\n", m.start())
            if end < 0:
                break
        group.append(m.start())
    if group:
        close()
    return out


class Block:
    """Reads the pieces of one block in order; positions count from the block's first byte.

    ``found`` holds position, successor, fields' description and whether the record is done: a candidate that the block ends before is
    handed out without its description. Only one record at a time is kept in memory besides the piece at hand: what begins
    inside it and goes on past its piece is handed out undone.
    """

    def __init__(self):
        self.at = 0
        self.found: list[tuple] = []
        self.heads: list[int] = []  # candidates whose header goes on
        self.held, self.base = bytearray(), 0
        self.open: tuple[int, dict, int, int] | None = None  # position, fields, begin and end of its block

    def add(self, piece: bytes, magic: bool) -> None:
        data = MAGIC + piece if magic else piece
        begin, self.at = self.at, self.at + len(data)
        starts = magic and piece[:3] in (b"0\r\n", b"1\r\n")
        if starts:
            self.heads.append(begin)
        if self.heads and not self.open and not self.held:
            self.base = self.heads[0]
        if self.open or self.heads:
            self.held += data
        if self.open and self.open[3] + 4 <= self.at:
            position, fields, a, b = self.open
            self.open = None
            if b + 4 == self.at and data[-4:] == b"\r\n\r\n":
                self.found.append((position, b + 4, *described(fields, bytes(self.held[a - self.base : b - self.base])), True))
        end = data.find(b"\r\n\r\n")
        if self.heads and end >= 0:
            end += begin
            heads, self.heads = self.heads, []
            for position, fields in header_fields(self.held, [h - self.base for h in heads], end - self.base):
                position += self.base
                n = block_length(fields)
                if n is None:
                    continue
                stop = end + 4 + n
                if stop + 4 < self.at or stop + 4 == self.at and data[-4:] != b"\r\n\r\n":
                    continue
                if stop + 4 == self.at:
                    self.found.append((position, self.at, *described(fields, bytes(self.held[end + 4 - self.base : stop - self.base])), True))
                elif self.open:
                    self.found.append((position, stop + 4, *[None] * 5, False))
                else:
                    self.open = position, fields, end + 4, stop
        if not self.open and not self.heads:
            self.held = bytearray()

    def close(self) -> list[tuple]:
        if self.open:
            self.found.append((self.open[0], self.open[3] + 4, *[None] * 5, False))
        self.found += [(h, None, *[None] * 5, False) for h in self.heads]
        self.open, self.heads, self.held = None, [], bytearray()
        return self.found


def block_edges(spark: SparkSession, path: str) -> DataFrame:
    """Candidates of all archives by block, positions counted from the block's first byte, and (``done`` null) each block's length as its ``successor``."""
    meta = lambda c: F.col(f"_metadata.{c}")
    pieces = spark.read.option("lineSep", MAGIC.decode()).text(path).select(meta("file_path").alias("file"), meta("file_block_start").alias("block"), meta("file_size").alias("size"), F.col("value").cast("binary").alias("piece"))
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("size", pa.int64()), ("offset", pa.int64()), ("successor", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()),
                        ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("done", pa.bool_())])

    def rows(key: tuple, found: list[tuple]) -> pa.RecordBatch:
        columns = [[k] * len(found) for k in key] + [list(c) for c in zip(*found, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def run(batches):
        key, block = None, Block()
        for b in batches:
            names = list(zip(*(b.column(i).to_pylist() for i in range(3)), strict=True))
            for k, piece in zip(names, b.column(3), strict=True):
                if k != key:
                    if key is not None:
                        yield rows(key, [*block.close(), (0, block.at, *[None] * 6)])
                    # only a file's first piece follows no magic
                    key, block, magic = k, Block(), k[1] > 0
                block.add(piece.as_py(), magic)
                magic = True
            if block.found:
                yield rows(key, block.found)
                block.found = []
        if key is not None:
            yield rows(key, [*block.close(), (0, block.at, *[None] * 6)])

    return pieces.mapInArrow(run, SCHEMA.replace("offset", "block bigint, size bigint, offset") + ", done boolean")


def emit_edges(files: DataFrame) -> DataFrame:
    """Candidates of archives (``path, content``), with the archive's ``size``."""

    def run(batches):
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                content = data.as_py()
                found = candidates(content)
                if content and not found:
                    raise ValueError(f"{path}: no record in {len(content)} bytes")
                columns = list(zip(*found, strict=True)) if found else [()] * 7
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(found), pa.string()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), pa.array([len(content)] * len(found), pa.int64())],
                    ["file", "offset", "successor", "record_type", "record_id", "refers_to", "payload_bytes", "payload_digest", "size"])

    return files.mapInArrow(run, SCHEMA + ", size bigint")


def reachable(offsets: np.ndarray, successors: np.ndarray, entries: np.ndarray | None = None) -> np.ndarray:
    """Which of the ascending offsets lie on the chains from the entries (offset 0, if none are given), by pointer jumping."""
    n = len(offsets)
    jump = _pointers(offsets, successors)
    seen = np.append(offsets == 0 if entries is None else entries, False)
    for _ in range(max(1, n).bit_length()):
        seen[jump[seen]] = True
        jump = jump[jump]
    return seen[:n]


def _pointers(offsets: np.ndarray, successors: np.ndarray) -> np.ndarray:
    """The index of each successor, the number of offsets for one that is none of them."""
    n = len(offsets)
    at = np.searchsorted(offsets, successors)
    return np.append(np.where((at < n) & (offsets[np.minimum(at, n - 1)] == successors), at, n) if n else at, n)


def exits(offsets: np.ndarray, successors: np.ndarray) -> np.ndarray:
    """Where the chain from each of the ascending offsets leaves them."""
    jump = _pointers(offsets, successors)
    last = np.append(successors, -1)
    for _ in range(max(1, len(offsets)).bit_length()):
        on = jump < len(offsets)
        last[on] = last[jump[on]]
        jump = jump[jump]
    return last[:-1]


def verified(edges: DataFrame) -> DataFrame:
    """The candidates on the chain of each file that was read as a whole, which must end at the file's length."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("offset")
        kept = table.filter(pa.array(reachable(table["offset"].to_numpy(), table["successor"].to_numpy())))
        ends, size = kept["successor"].to_pylist()[-1:], table["size"][0].as_py()
        if ends != [size]:
            raise ValueError(f"{table['file'][0]}: the chain of records ends at {ends}, the file at {size}")
        return kept.drop_columns("size")

    return edges.groupBy("file").applyInArrow(run, SCHEMA)


def entries(edges: DataFrame, several: DataFrame) -> DataFrame:
    """``file, offset`` where the chain from offset 0 enters each block. Files of ``several`` blocks are followed by joins that double the reach."""
    starts = edges.select("file").distinct().withColumn("offset", F.lit(0).cast("long"))
    if several.isEmpty():
        return starts

    def leave(table: pa.Table) -> pa.Table:
        table = table.sort_by("offset")
        return pa.table({"file": table["file"], "offset": table["offset"], "to": pa.array(exits(table["offset"].to_numpy(), table["successor"].fill_null(-1).to_numpy()))})

    jumps = materialize(edges.join(several, "file", "left_semi").select("file", "block", "offset", "successor").groupBy("file", "block").applyInArrow(leave, "file string, offset bigint, to bigint"), "exits")
    seen = several.select("file", F.lit(0).cast("long").alias("offset"))
    n = 0
    while True:
        seen = materialize(seen.unionByName(seen.join(jumps, ["file", "offset"]).select("file", F.col("to").alias("offset"))).distinct(), "entries")
        if (m := seen.count()) == n:
            break
        n = m
        further = jumps.select("file", F.col("offset").alias("to"), F.col("to").alias("beyond"))
        jumps = materialize(jumps.join(further, ["file", "to"]).select("file", "offset", F.col("beyond").alias("to")), "exits")
    return starts.unionByName(seen).distinct()


def on_chain(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """The candidates on the chains that enter their blocks at ``starts``; a block is one task's."""
    marked = edges.join(starts.withColumn("entry", F.lit(True)), ["file", "offset"], "left").select(*edges.columns, F.coalesce("entry", F.lit(False)).alias("entry"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in edges.schema)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("offset")
        kept = reachable(table["offset"].to_numpy(), table["successor"].fill_null(-1).to_numpy(), table["entry"].to_numpy())
        return table.filter(pa.array(kept)).drop_columns("entry")

    return marked.groupBy("file", "block").applyInArrow(run, kinds)


def chained(spark: SparkSession, path: str) -> DataFrame:
    """Records of all archives of a folder, by ``SCHEMA``."""
    read = materialize(block_edges(spark, path), "edges")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # one row a block
    blocks = materialize(read.where("done IS NULL").select("file", "block", "size", F.coalesce(F.sum("successor").over(before), F.lit(0)).alias("base")), "blocks")
    edges = read.where("done IS NOT NULL").join(blocks.select("file", "block", "base"), ["file", "block"])
    edges = edges.withColumns({"offset": F.col("offset") + F.col("base"), "successor": F.col("successor") + F.col("base")}).drop("base")
    several = blocks.groupBy("file").agg(F.count("*").alias("n")).where("n > 1").select("file")
    kept = materialize(on_chain(edges, entries(edges, several)), "chained")
    whole = kept.groupBy("file").agg(F.max("successor").alias("end"), F.bool_and("done").alias("all"))
    bad = blocks.select("file", "size").distinct().join(whole, "file", "left").where(~F.coalesce((F.col("end") == F.col("size")) & F.col("all"), F.lit(False)))
    names = [r["file"] for r in bad.select("file").collect()]  # none, as a rule; names only
    records = kept.select(*(x.split(" ")[0] for x in SCHEMA.split(", ")))
    if not names:
        return records
    files = spark.read.format("binaryFile").load([urllib.parse.unquote(x) for x in names]).select("path", "content")
    return records.where(~F.col("file").isin(names)).unionByName(verified(emit_edges(files)))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records of all archives of a folder; revisits take the payload's length from the response they refer to."""
    bounded_batches(spark)
    records = materialize(chained(spark, path), "records")
    first = records.where(F.col("record_type") == "response").groupBy("record_id").agg(F.max(F.struct("payload_bytes", "payload_digest")).alias("full"))
    again = (
        records.where(F.col("record_type") == "revisit").drop("payload_bytes")
        .join(first.withColumnRenamed("record_id", "refers_to"), "refers_to", "left")
        .select("file", "offset", "record_type", "record_id", "refers_to", F.col("full.payload_bytes").alias("payload_bytes"), "payload_digest")
    )
    return records.where(F.col("record_type") != "revisit").select("file", "offset", "record_type", "record_id", "refers_to", "payload_bytes", "payload_digest").unionByName(again)


def page_number(name: str) -> Column:
    return F.regexp_extract(name, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    write_archives(pages, path)
    return read_archives(spark, path).select(
        page_number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_number("refers_to").alias("refers_to"))
