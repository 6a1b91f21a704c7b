"""Order MinHash fingerprints (native: DataFrame expressions only).

A text's symbols are its words of up to 16 characters; a longer run without white space is taken character by character, so
that an inserted character moves nothing but the k-mers it stands in. Its k-mers are three symbols (a shorter text: all
of them), each numbered by its occurrence. One hash of (k-mer, occurrence) both deals the k-mers out over 64
bins (one permutation in place of 64) and orders them inside; the two least of a bin, put back in text order,
are hashed into the bin's entry. Entries depend on which k-mers a text has, how often, and in which order, so
likeness falls with edit distance. A fingerprint is the hex of its entries, bin by bin; bins without a k-mer have none.

Short texts have few words that an edit could leave whole: bin ``b`` takes k-mers over characters (white space left out) instead
if the text has fewer symbols than the bin's bound. The bounds grow from 8 to 64, so texts of under 8 symbols use characters alone, those of 64
or more none, and a text that grows by a word changes the kind of a few bins only.

Defined results: a null text counts as the empty text, whose fingerprint is the empty string; two empty
fingerprints have likeness 1; repeated rows and ties get equal fingerprints; texts of any length are taken whole
(sorts of plain longs, no quadratic step); other columns of the input are not read; ids may be any longs. In ``with_next`` a row
with a null id has no place in the order and the empty text as its next one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, let, materialize, text_of

K = 3
TUPLE = 2
BIN_BITS = 6
_SHIFT = 30
RANGE_BYTES = 64 << 20
MOST_RANGES = 1 << 17
_POSITION = (1 << _SHIFT) - 1


#: Words of up to 16 characters, every character of longer runs.
_WORDS = r"((?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]{1,16}(?![^\x20\x09-\x0D])|[^\x20\x09-\x0D])"
_CHARS = r"([^\x20\x09-\x0D])"
#: A bin takes k-mers over characters for texts of fewer symbols than this.
_BOUNDS = [round(8 * 8 ** (b / ((1 << BIN_BITS) - 1))) for b in range(1 << BIN_BITS)]


def _symbols(text: Column, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda w: F.xxhash64(w))


def _kmers(symbols: Column) -> Column:
    """Hashes of the k-mers in text order."""

    def joined(h: Column) -> Column:
        n = F.size(h)
        return F.transform(F.slice(h, F.lit(1), F.greatest(n - (K - 1), F.least(n, F.lit(1)))), lambda x, i: F.xxhash64(x, *(F.get(h, i + j) for j in range(1, K))))

    return let(symbols, joined)


def _of_bin(x: Column) -> Column:
    return F.shiftright(x, 64 - BIN_BITS)


def _chosen(text: Column) -> Column:
    """The numbered k-mers of a text, each bin of the kind that the text's number of symbols asks for."""
    bounds = F.array(*map(F.lit, _BOUNDS))

    def mixed(h: Column) -> Column:
        short = lambda x: F.get(bounds, (_of_bin(x) + (1 << (BIN_BITS - 1))).cast("int")) > F.size(h)
        words = F.filter(_numbered(_kmers(h)), lambda x: ~short(x))
        chars = F.filter(_numbered(_kmers(_symbols(text, _CHARS))), short)
        return F.when(F.size(h) >= max(_BOUNDS), _numbered(_kmers(h))).otherwise(F.sort_array(F.concat(words, chars)))

    return let(_symbols(text, _WORDS), mixed)


def _numbered(kmers: Column) -> Column:
    """Longs that hold the hash of (k-mer, occurrence) above and the position below, sorted."""

    def code(h: Column, p: Column) -> Column:
        return h.bitwiseAND(~_POSITION).bitwiseOR(p.cast("long"))

    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: ~F.get(s, i)["h"].eqNullSafe(F.get(s, i - 1)["h"]))
        return let(starts, lambda b: F.flatten(F.transform(b, lambda at, r: F.transform(
            F.slice(s, at + 1, F.coalesce(F.get(b, r + 1), F.size(s)) - at),
            lambda e, j: code(F.when(j == 0, e["h"]).otherwise(F.xxhash64(e["h"], j)), e["p"])))))

    def coded(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.transform(h, code)).otherwise(let(placed, runs))

    return F.sort_array(let(kmers, coded))


def fingerprint(text: Column) -> Column:
    """Entries of a text: ints with the bin in the upper and the tuple's hash in the lower 16 bits."""
    def entry(x: Column, y: Column) -> Column:
        ident = lambda v: F.shiftright(v, _SHIFT)
        other = F.when(_of_bin(x) == _of_bin(y), y)
        ordered = F.when(other.isNull(), F.xxhash64(ident(x))).when(
            x.bitwiseAND(_POSITION) < y.bitwiseAND(_POSITION), F.xxhash64(ident(x), ident(y))).otherwise(F.xxhash64(ident(y), ident(x)))
        return (F.shiftleft(_of_bin(x) + (1 << (BIN_BITS - 1)), 16) + ordered.bitwiseAND(0xFFFF)).cast("int")

    def entries(least: Column) -> Column:
        made = F.transform(least, lambda x, i: F.when(~_of_bin(x).eqNullSafe(_of_bin(F.get(least, i - 1))), entry(x, F.get(least, i + 1))))
        return F.filter(made, lambda x: x.isNotNull())

    least = let(_chosen(text), lambda s: F.filter(s, lambda x, i: ~_of_bin(x).eqNullSafe(_of_bin(F.get(s, i - TUPLE)))))
    return let(least, entries)


def as_hex(entries: Column) -> Column:
    return F.array_join(F.transform(entries, lambda x: F.lpad(F.lower(F.hex(x)), 6, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Equal entries among the bins that either text uses."""
    bins = lambda e: F.transform(e, lambda x: F.shiftright(x, 16))
    either = F.size(a) + F.size(b) - F.size(F.array_intersect(bins(a), bins(b)))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def range_borders(df: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column, Column, int]:
    """Borders that cut ids into ranges of about ``RANGE_BYTES`` of text, descending.

    Returns expressions of an id ``_id``'s row ``_row`` in the square of borders, of its range ``_range`` in that row, of the range's border, and
    the number of ranges. Borders are ids of the table, picked evenly from a sample by size, and the greatest id; they stay
    longs throughout. There are at most ``MOST_RANGES``; held as a square they are looked up in two short scans.
    """
    slim = materialize(df.select(F.col(id_col).cast("long").alias("id"), (F.octet_length(text_of(text_col)) + 8).cast("long").alias("size")).where(F.col("id").isNotNull()), "range-sizes")
    top, total = slim.agg(F.max("id"), F.sum("size")).first()
    if top is None:
        return F.lit(0), F.lit(0), F.lit(0), 1
    parts = min(MOST_RANGES, max(-(-total // RANGE_BYTES), 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    scale, step = 1 << 30, max(1, total // (8 * parts))
    # a row is taken with a chance in proportion to its size: at most about 8 * parts rows
    sample = slim.where(F.pmod(F.xxhash64("id", F.lit("cut")), F.lit(scale)).cast("double") * step < F.col("size").cast("double") * scale)
    held = sample.agg(F.sort_array(F.collect_list("id")).alias("s"))
    picks = F.transform(F.sequence(F.lit(1), F.lit(parts)), lambda i: F.get("s", F.floor(i.cast("long") * F.size("s") / (parts + 1)).cast("int")))
    found = held.select(F.sort_array(F.array_distinct(F.filter(F.concat(picks, F.array(F.lit(top).cast("long"))), lambda x: x.isNotNull())), asc=False)).first()[0]
    width = math.isqrt(len(found)) + 1
    # a cast of constant text is folded into one constant; a long list of literals would be an expression each
    longs = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>")
    at_least = lambda xs, key: F.size(F.filter(xs, lambda b: b >= key))
    key, row = F.col("_id"), F.col("_row")
    number = row * width + at_least(F.slice(longs(found), row * width + 1, F.lit(width)), key) - 1
    return at_least(longs(found[::width]), key) - 1, number, F.get(longs(found), F.col("_range")), len(found)


def with_next(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, Window, Column]:
    """Rows dealt into ranges of descending ids, the window over a range, and the mark of rows that only end a range.

    The first row of each range stands once more at the end of the range before, and the very first at the end of the
    last, so that a lead inside a range crosses its border.
    """
    spread = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    row, number, border, n = range_borders(df, id_col, text_col)
    key = F.col("_id")
    bucket = F.when(key.isNull(), -1 - F.pmod(F.xxhash64("_text"), F.lit(spread))).otherwise(F.col("_range"))
    own = F.struct(F.col("_bucket").alias("b"), F.lit(False).alias("end"))
    again = F.struct(F.pmod(F.col("_bucket") - 1, F.lit(n)).alias("b"), F.lit(True).alias("end"))
    rows = (
        df.select(F.col(id_col).cast("long").alias("_id"), text_of(text_col).alias("_text"))
        .withColumn("_row", row).withColumn("_range", number).withColumn("_bucket", bucket.cast("int"))
        .withColumn("_at", F.explode(F.when(key == border, F.array(own, again)).otherwise(F.array(own))))
        .select("_id", "_text", F.col("_at.b").alias("_bucket"), F.col("_at.end").alias("_end"), F.xxhash64("_text").alias("_tie"))
    )
    return rows, Window.partitionBy("_bucket").orderBy(F.col("_end"), F.desc("_id"), F.col("_tie")), F.col("_end")


def fingerprint_edits(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edit (last third replaced from the next text) and their likeness."""
    rows, window, is_end = with_next(df, id_col, text_col)
    n = F.length("_text").cast("int")
    third = F.floor(n / 3).cast("int")
    paired = rows.withColumn("_next", F.when(F.col("_id").isNull(), F.lit("")).otherwise(F.lead("_text").over(window)))
    edited = F.concat(F.substring(F.col("_text"), F.lit(1), n - third), F.substring(F.coalesce("_next", F.lit("")), F.lit(1), third))
    made = paired.select("_id", "_bucket", "_end", "_tie", "_text", n.cast("long").alias("n_chars"), edited.alias("_edited"))
    made = made.select(
        "_id", "_bucket", "_end", "_tie", "n_chars",
        F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("_text")).alias("_fp"),
        F.when(F.col("_end"), F.array().cast("array<int>")).otherwise(fingerprint(F.col("_edited"))).alias("_efp"),
    )
    empty = F.array().cast("array<int>")
    made = made.withColumn("_nfp", F.when(F.col("_id").isNull(), empty).otherwise(F.coalesce(F.lead("_fp").over(window), empty))).where(~is_end)
    return made.select(
        F.col("_id").alias(id_col), "n_chars", "edited_sha256",
        as_hex(F.col("_fp")).alias("fingerprint"), as_hex(F.col("_efp")).alias("edited_fingerprint"),
        likeness(F.col("_fp"), F.col("_efp")).alias("near_edited"), likeness(F.col("_fp"), F.col("_nfp")).alias("near_next"),
    )


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(documents(spark, sf_dir))
