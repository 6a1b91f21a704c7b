"""Quality rules as a bitmask ledger (native: DataFrame expressions only).

``ledger`` evaluates every rule once and keeps its measurements and one bit a failed rule; ``apply_policy``
reads a versioned policy (a mask of the rules that count) off the bits, and ``ablation`` tells from the
same bits, without another look at a text, what each rule of a policy removes alone.

Defined results: a null text counts as the empty text and fails ``few_words``; equal rows get equal
ledgers and stay apart; an empty table gives an empty ledger; columns of the input whose names are taken
by the ledger are not read (``ledger`` returns the id and its own columns only, ``filter_documents``
returns exactly the input's columns).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_GROUP, documents, let, text_of

_SHIFT = 30
_POSITION = (1 << _SHIFT) - 1


def repeated_window_words(words: Column) -> Column:
    """Words that lie in a three-word window found at least twice in the text.

    Window hashes are sorted as plain longs with the position in the low 30 bits; only windows whose high
    bits meet a neighbour's are compared by the full 64 bits. Linear but for two sorts, whatever repeats.
    """

    def neighbour(array: Column, i: Column, value) -> Column:
        here = value(F.get(array, i))
        return here.eqNullSafe(value(F.get(array, i - 1))) | here.eqNullSafe(value(F.get(array, i + 1)))

    def covered(hashes: Column, order: Column) -> Column:
        near = F.filter(order, lambda x, i: neighbour(order, i, lambda v: F.shiftright(v, _SHIFT)))
        pairs = F.sort_array(F.transform(near, lambda x: F.struct(
            F.get(hashes, x.bitwiseAND(_POSITION).cast("int")).alias("h"), x.bitwiseAND(_POSITION).cast("int").alias("p"))))
        again = let(pairs, lambda s: F.filter(s, lambda x, i: neighbour(s, i, lambda v: v["h"])))
        places = F.sort_array(F.transform(again, lambda x: x["p"]))
        return F.aggregate(
            places,
            F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("sum")),
            lambda a, p: F.struct(p.alias("last"), (a["sum"] + F.least(F.lit(3), p - a["last"])).alias("sum")),
            lambda a: a["sum"],
        )

    windows = F.transform(
        F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)),
    )
    return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(
        F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(~_POSITION).bitwiseOR(i.cast("long")))),
        lambda order: covered(h, order),
    )))


def measurements(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: the id and what the rules look at."""
    t = F.col("t")
    words = (
        df.select(F.col(id_col), text_of(text_col).alias("t"))
        .select(
            id_col, "t",
            F.regexp_extract_all(t, F.lit(WORD_GROUP), F.lit(1)).alias("w"),
            F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        )
    )
    count = lambda cls: F.length(t) - F.length(F.regexp_replace(t, cls, ""))
    return words.select(
        id_col,
        F.size("w").cast("long").alias("n_words"),
        (F.length(t) - count(r"[^\x20\x09-\x0D]+")).alias("_space_chars"),
        F.length(t).cast("long").alias("_chars"),
        count(r"[#*$%&|<>]+").cast("long").alias("n_symbols"),
        count(r"\p{Lu}+").cast("long").alias("n_upper"),
        count(r"\p{L}+").cast("long").alias("n_letters"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_window_words(F.col("w")).alias("n_repeat_words"),
    ).select(
        id_col, "n_words", (F.col("_chars") - F.col("_space_chars")).cast("long").alias("word_chars"),
        "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_lines",
    )


def rules() -> list[tuple[str, Column]]:
    """Name and failing condition of every rule; a rule's bit is its place in this list, so rules are only ever appended."""
    c = F.col
    return [
        ("few_words", c("n_words") < 50),
        ("repeated_windows", 100 * c("n_repeat_words") > 50 * c("n_words")),
        ("symbols", 10 * c("n_symbols") > c("n_words")),
        ("duplicate_lines", (c("n_lines") >= 4) & (2 * c("n_dup_lines") > c("n_lines"))),
        ("shouting", (c("n_letters") >= 40) & (2 * c("n_upper") > c("n_letters"))),
        ("short_words", 2 * c("word_chars") < 5 * c("n_words")),
        ("long_words", c("word_chars") > 14 * c("n_words")),
        ("few_letters", 2 * c("n_letters") < c("word_chars")),
    ]


RULE_NAMES = ("few_words", "repeated_windows", "symbols", "duplicate_lines", "shouting", "short_words", "long_words", "few_letters")
BASE = ("few_words", "repeated_windows")
#: Policies by version: the rules that count. A version never changes once released.
POLICIES = {
    "base": BASE,
    "v1": (*BASE, "symbols", "duplicate_lines"),
    "v2": (*BASE, "symbols", "duplicate_lines", "shouting", "short_words", "long_words", "few_letters"),
}
CURRENT = "v2"


def mask_of(policy: str) -> int:
    return sum(1 << RULE_NAMES.index(x) for x in POLICIES[policy])


def ledger(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements and ``fail_bits``, each rule evaluated once."""
    bits = F.lit(0).cast("long")
    for i, (_, failed) in enumerate(rules()):
        bits = bits.bitwiseOR(F.when(failed, F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return measurements(df, id_col=id_col, text_col=text_col).withColumn("fail_bits", bits)


def apply_policy(book: DataFrame, policy: str = CURRENT) -> DataFrame:
    """``base_failed`` and ``kept`` of a policy, from the bits alone."""
    bits = F.col("fail_bits")
    return book.withColumn("base_failed", bits.bitwiseAND(mask_of("base")) != 0).withColumn("kept", bits.bitwiseAND(mask_of(policy)) == 0)


def ablation(book: DataFrame, policy: str = CURRENT) -> DataFrame:
    """A row a rule of the policy: documents it fails, documents only it fails (what leaving it out would bring back).

    One pass: partial counts by distinct bit pattern (at most 2^rules of them), then the rules read those patterns.
    """
    mask = mask_of(policy)
    patterns = book.groupBy(F.col("fail_bits").bitwiseAND(mask).alias("bits")).agg(F.count("*").alias("n"))
    named = F.array(*(F.struct(F.lit(x).alias("rule"), F.lit(1 << RULE_NAMES.index(x)).cast("long").alias("bit")) for x in POLICIES[policy]))
    return (
        patterns.select("bits", "n", F.explode(named).alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n"))), F.lit(0)).alias("n_failed"),
            F.coalesce(F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n"))), F.lit(0)).alias("n_only"),
        )
    )


def filter_documents(df: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The documents that the policy keeps, with the input's columns and nothing shuffled: the ledger is computed beside each row."""
    held = df.select(F.struct("*").alias("row"), F.col("text"))
    judged = apply_policy(ledger(held, id_col="row"), policy)
    # A filter is pushed through deterministic columns and would carry every measurement, written out again at each mention, with it.
    return judged.withColumn("_at", F.monotonically_increasing_id()).where(F.col("kept") & (F.col("_at") >= 0)).select("row.*")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = apply_policy(ledger(documents(spark, sf_dir)))
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")
