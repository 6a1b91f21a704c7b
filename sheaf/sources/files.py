"""Small files and folders on whatever file system Spark reaches: through the Hadoop API, never through ``open`` or ``os``."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, sorted; none where there is no folder."""
    fs, p = _at(spark, folder)
    return sorted(str(s.getPath().getName()) for s in fs.listStatus(p)) if fs.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _at(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A new file; one that is there is an error."""
    fs, p = _at(spark, path)
    stream = fs.create(p, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def make_folder(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.mkdirs(p)


def rename(spark: SparkSession, source: str, target: str) -> bool:
    """Whether the name changed; a target that is there stays."""
    fs, p = _at(spark, source)
    to = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    return not fs.exists(to) and fs.rename(p, to)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


class Conflict(RuntimeError):
    """Another writer committed the version first."""


def last_version(spark: SparkSession, path: str) -> dict | None:
    """What the last committed version of a store says; nothing if there is none."""
    found = [n for n in names(spark, f"{path}/manifests") if n.endswith(".json")]
    return json.loads(read_text(spark, f"{path}/manifests/{found[-1]}")) if found else None


def commit_version(spark: SparkSession, path: str, made: dict) -> None:
    """Make ``made``, with its number in ``version``, the last version of a store: one rename, so that readers see all of it or nothing."""
    make_folder(spark, f"{path}/manifests")
    draft = f"{path}/draft-{uuid.uuid4().hex}"
    write_text(spark, draft, json.dumps(made))
    if not rename(spark, draft, f"{path}/manifests/{made['version']:012d}.json"):
        raise Conflict(f"version {made['version']} of {path} is there already")


def vacuum(spark: SparkSession, path: str, named: set[str]) -> None:
    """Remove what the last version of a store does not name: older manifests first, then folders and drafts."""
    last = last_version(spark, path)
    if last is None:
        return
    for n in names(spark, f"{path}/manifests"):
        if n != f"{last['version']:012d}.json":
            delete(spark, f"{path}/manifests/{n}")
    for n in names(spark, path):
        if n not in named and n != "manifests":
            delete(spark, f"{path}/{n}")
