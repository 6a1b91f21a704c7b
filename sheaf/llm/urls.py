"""URL filter by a sort-merge range join.

A host becomes a key of its labels from last to first, each ended by a slash (which no host holds): ``blog.example.net`` is
``net/example/blog/``. All keys that begin with a rule's key, its host and the subdomains, are one interval of the sorted
keys. Addresses are dealt into ranges of (key, path), rules into the ranges that their intervals touch; in each range both
are sorted together and swept once with a stack of the rules' hosts that hold the current key: a host is pushed where
its interval begins and popped where it ends. A host on the stack keeps its rules' paths in order, each with the longest other path it
continues, so the longest path that an address continues is found by one binary search and a walk along those. Of the rules that
fit, the one whose host and path are longest together wins; of equally long ones that with the longer host.

The borders of the ranges come from a sample of the addresses, drawn to a hundred a range; they decide where the work is done and
nothing else. A random number ends the order, so an address or a host that holds a large part of all rows fills several ranges. A sweep holds the
stack, not the range. A rule is copied to each range that its interval touches: for a host with many paths and many subdomains
that is paths times the ranges that the subdomains fill.

Defined results: a null address, or one without ``://``, has an empty host and path, which fit no rule; an address that ends after the host has
an empty path, which does not continue ``/``. Rules without a host, a path or a verdict fit nothing; of rules for the same host and
path, ``block`` wins. Repeated rows and null ids are judged row by row; an empty table gives an empty result, no rules the default.
Only the id and the address are read, so other columns may have any name.
"""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The rules of the registered query: verdict, host, path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Sampled addresses and ranges for each shuffle partition.
SAMPLED, RANGES = 100, 4


def host_of(url: Column) -> Column:
    """What stands after the first ``://``, up to a slash, question mark, hash or the end; A to Z in lower case."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to a question mark, hash or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)://[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "/"), F.lit("/"))


def _borders(addresses: DataFrame, ranges: int) -> list[tuple[bytes, bytes, float]]:
    """The least row of each range but the first, of ``ranges`` about equal ones: a row a range reaches the driver."""
    total = addresses.count()
    if total == 0:
        return []
    sample = addresses.sample(min(1.0, SAMPLED * ranges / total), seed=13)
    dealt = sample.repartitionByRange(ranges, "key", "path", "salt").select(F.spark_partition_id().alias("range"), F.struct("key", "path", "salt").alias("at"))
    least = dealt.groupBy("range").agg(F.min("at").alias("at")).select("at.*").collect()
    return sorted((r.key.encode(), r.path.encode(), r.salt) for r in least)[1:]


class _Frame:
    """A host on the stack: its rules by path, each with the place of the longest path before it that it continues (-1: none)."""

    def __init__(self, key: str, host: str):
        self.key, self.host = key, host
        self.paths: list[str] = []
        self.verdicts: list[str] = []
        self.inside: list[int] = []

    def _walk(self, at: int, path: str) -> int:
        while at >= 0 and not path.startswith(self.paths[at]):
            at = self.inside[at]
        return at

    def add(self, path: str, verdict: str) -> None:
        self.inside.append(self._walk(len(self.paths) - 1, path))
        self.paths.append(path)
        self.verdicts.append(verdict)

    def longest(self, path: str) -> int:
        return self._walk(bisect_right(self.paths, path) - 1, path)


def _winner(stack: list[_Frame], path: str) -> tuple[str | None, str | None]:
    best, rule, verdict = -1, None, None
    for frame in stack:  # from the shortest host to the longest
        at = frame.longest(path)
        if at >= 0 and len(frame.host) + len(frame.paths[at]) >= best:
            best, rule, verdict = len(frame.host) + len(frame.paths[at]), frame.host + frame.paths[at], frame.verdicts[at]
    return rule, verdict


def judge(pages: DataFrame, rules: DataFrame, *, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``id, host, path, rule, verdict`` of every row; ``rules (verdict, host, path)``, ``rule`` reads host and path."""
    spark = pages.sparkSession
    bounded_batches(spark)
    kind = dict(pages.dtypes)[id_col]
    url = F.col("url")
    addresses = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).select("id", host_of(url).alias("host"), path_of(url).alias("path"))
    addresses = addresses.withColumn("key", host_key(F.col("host"))).withColumn("salt", F.rand(29))
    borders = _borders(addresses.select("key", "path", "salt"), RANGES * int(spark.conf.get("spark.sql.shuffle.partitions")))
    whole = rules.select("verdict", F.translate("host", UPPER, LOWER).alias("host"), "path").where((F.col("host") != "") & F.col("path").isNotNull() & F.col("verdict").isNotNull())
    whole = whole.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).withColumn("key", host_key(F.col("host")))

    def deal(batches):
        for b in batches:
            keys, paths, salts = (b.column(i).to_pylist() for i in (3, 2, 4))
            at = [bisect_right(borders, (k.encode(), p.encode(), s)) for k, p, s in zip(keys, paths, salts, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(b.column(i) for i in range(4))], ["range", "id", "host", "path", "key"])

    def copies(batches):
        for b in batches:
            rows = []
            for verdict, host, path, key in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                k, p = key.encode(), path.encode()
                # no UTF-8 text holds the byte 255: the host's own addresses that continue the path, then all addresses of its subdomains
                spans = ((k, p, -1.0), (k, p + b"\xff", 0.0)), ((k, b"\xff", 0.0), (k + b"\xff", b"", 0.0))
                touched = {r for least, most in spans for r in range(bisect_right(borders, least), bisect_right(borders, most) + 1)}
                rows += [(r, host, path, key, verdict) for r in sorted(touched)]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.string()) for c in columns[1:])], ["range", "host", "path", "key", "verdict"])

    def sweep(batches):
        here, stack, last = None, [], None
        for b in batches:
            ids, out = [], []
            for i, (r, key, is_url, path, host, verdict) in enumerate(zip(*(b.column(j).to_pylist() for j in (0, 1, 2, 3, 5, 6)), strict=True)):
                if r != here:
                    here, stack, last = r, [], None
                while stack and not key.startswith(stack[-1].key):
                    stack.pop()
                if not is_url:
                    if not stack or stack[-1].key != key:
                        stack.append(_Frame(key, host))
                    stack[-1].add(path, verdict)
                    continue
                if last is None or last[0] != key or last[1] != path:
                    last = (key, path, *_winner(stack, path))
                ids.append(i)
                out.append((host, path, last[2], last[3] or default))
            if out:
                yield pa.RecordBatch.from_arrays([b.column(4).take(pa.array(ids)), *(pa.array(c, pa.string()) for c in zip(*out, strict=True))], [id_col, "host", "path", "rule", "verdict"])

    asked = addresses.select("id", "host", "path", "key", "salt").mapInArrow(deal, f"range int, id {kind}, host string, path string, key string")
    given = whole.select("verdict", "host", "path", "key").mapInArrow(copies, "range int, host string, path string, key string, verdict string")
    both = asked.select("range", "key", F.lit(True).alias("is_url"), "path", "id", "host", F.lit(None).cast("string").alias("verdict")).unionByName(
        given.select("range", "key", F.lit(False).alias("is_url"), "path", F.lit(None).cast(kind).alias("id"), "host", "verdict"))
    swept = both.repartition("range").sortWithinPartitions("range", "key", "is_url", "path")
    return swept.mapInArrow(sweep, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")


def op13_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)
