"""Stored tables by key: rows in buckets by a hash, versions committed by one rename.

A change reads the buckets that its rows fall into and no others, writes a new folder with those buckets only, and commits a manifest that says which
folders make up each bucket. ``append`` adds rows whose key the table lacks and writes nothing but them; ``merge`` rewrites the
touched buckets from their old and new rows. Folders are never changed, so a reader keeps the version that it opened, and a job that
dies leaves the last version as it was. One writer at a time (``files.Conflict``).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.session import written

from . import files

#: Buckets of a new table, kept from then on: so many that one can be rewritten at ease (a hundred thousand million rows ask for thousands).
BUCKETS = 64
#: Folders of a bucket before an append rewrites it as one.
MOST_FOLDERS = 16


@dataclass(frozen=True)
class Table:
    """``folders``: of each bucket that has rows; ``by``: the columns whose hash is the bucket; ``key``: those that name a row."""

    version: int
    buckets: int
    by: list[str]
    key: list[str]
    schema: str
    folders: dict[str, list[str]]


def opened(spark: SparkSession, path: str) -> Table | None:
    found = files.last_version(spark, path)
    return Table(**found) if found else None


def _bucket(by: list[str], n: int) -> Column:
    return F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")


def read(spark: SparkSession, path: str, schema: str | None = None, buckets: set[int] | None = None) -> DataFrame:
    """The table as it was last committed, or the given buckets of it; an empty one of the given schema where there is none."""
    t = opened(spark, path)
    if t is None:
        if schema is None:
            raise FileNotFoundError(f"no table in {path}")
        return spark.createDataFrame([], schema)
    paths = [f"{path}/{f}/_bucket={b}" for b, folders in t.folders.items() if buckets is None or int(b) in buckets for f in folders]
    return spark.read.schema(t.schema).parquet(*paths) if paths else spark.createDataFrame([], t.schema)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in df.dtypes)


def _started(new: DataFrame, path: str, key: list[str], by: list[str] | None, buckets: int) -> Table:
    found = opened(new.sparkSession, path)
    return found or Table(0, buckets, by or key, key, _ddl(new), {})


def _touched(df: DataFrame) -> set[int]:
    """Buckets of the rows: as many numbers as there are buckets at most."""
    return {r[0] for r in df.select("_bucket").distinct().collect()}


def _put(t: Table, rows: DataFrame, path: str, replaced: bool) -> Table:
    """Write rows by ``_bucket`` into a folder of their own and commit it, in place of the buckets' folders or beside them."""
    folder = f"rows-{uuid.uuid4().hex}"
    # small buckets share a task, a large one is dealt to several
    rows.hint("rebalance", "_bucket").sortWithinPartitions("_bucket", *t.key).write.partitionBy("_bucket").parquet(f"{path}/{folder}")
    made = {n.removeprefix("_bucket=") for n in files.names(rows.sparkSession, f"{path}/{folder}") if n.startswith("_bucket=")}
    folders = dict(t.folders)
    for b in made:
        folders[b] = [folder] if replaced else [*folders.get(b, []), folder]
    out = Table(t.version + 1, t.buckets, t.by, t.key, t.schema, folders)
    files.commit_version(rows.sparkSession, path, asdict(out))
    return out


def append(new: DataFrame, path: str, key: list[str], *, by: list[str] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Add the rows whose key the table lacks (repeats inside the batch stay) and return them. ``by``: columns that the key determines, if a batch's keys shall fall into few buckets."""
    spark = new.sparkSession
    t = _started(new, path, key, by, buckets)
    held = written(new.select(*_columns(t)).withColumn("_bucket", _bucket(t.by, t.buckets)), "batch")
    touched = _touched(held)
    fresh = held
    if touched & {int(b) for b in t.folders}:
        stored = read(spark, path, t.schema, touched).select(*t.key)
        same = F.lit(True)
        for c in t.key:
            same = same & held[c].eqNullSafe(stored[c])
        # keys alone tell whether all rows are new; then the batch as it was written serves
        if not held.select(*t.key).join(stored, same, "left_semi").isEmpty():
            fresh = written(held.join(stored, same, "left_anti"), "fresh")
    if not fresh.isEmpty() or t.version == 0:
        long = {b for b in _touched(fresh) if len(t.folders.get(str(b), [])) >= MOST_FOLDERS}
        rows = fresh
        if long:
            rows = rows.unionByName(read(spark, path, t.schema, long).withColumn("_bucket", _bucket(t.by, t.buckets)))
            t = Table(t.version, t.buckets, t.by, t.key, t.schema, {b: f for b, f in t.folders.items() if int(b) not in long})
        _put(t, rows, path, replaced=False)
    return fresh.drop("_bucket")


def _columns(t: Table) -> list[str]:
    from pyspark.sql.types import StructType

    return [f"`{f.name}`" for f in StructType.fromDDL(t.schema).fields]


def merge(new: DataFrame, path: str, key: list[str], combine: Callable[[DataFrame], DataFrame], *, buckets: int = BUCKETS) -> None:
    """Put rows together with the stored ones of their buckets: ``combine`` gets old and new rows, old ones with ``_new`` false, and returns those to keep, one a key as a rule (without ``_new``)."""
    spark = new.sparkSession
    t = _started(new, path, key, None, buckets)
    held = written(new.select(*_columns(t)).withColumn("_bucket", _bucket(t.by, t.buckets)), "batch")
    touched = _touched(held)
    if not touched and t.version:
        return
    stored = read(spark, path, t.schema, touched)
    both = held.drop("_bucket").withColumn("_new", F.lit(True)).unionByName(stored.withColumn("_new", F.lit(False)))
    _put(t, combine(both).select(*_columns(t)).withColumn("_bucket", _bucket(t.by, t.buckets)), path, replaced=True)


def vacuum(spark: SparkSession, path: str) -> None:
    """Remove what the last version does not name."""
    t = opened(spark, path)
    if t:
        files.vacuum(spark, path, {f for folders in t.folders.values() for f in folders})
