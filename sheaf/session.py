"""Session defaults."""

from __future__ import annotations

import gc
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.config(map=DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()})
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", shuffle_partitions)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where neither that setting nor a checkpoint folder of the context exists and all tasks run on this machine (as in tests)
    a temporary folder takes its place, and is kept as the context's checkpoint folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if context.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="sheaf-"))
    return context.getCheckpointDir().rstrip("/")


#: Tables of the ``scratch`` scopes that are open, innermost last; each thread has scopes of its own.
_scratch: ContextVar[tuple[list[str], ...]] = ContextVar("scratch", default=())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``written`` makes inside go at the end, but for those to keep; so do the shuffles that nothing refers to any more."""
    token = _scratch.set((*_scratch.get(), []))
    try:
        yield
    finally:
        own = _scratch.get()[-1]
        _scratch.reset(token)
        jvm = spark.sparkContext._jvm
        for path in own:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        gc.collect()
        jvm.System.gc()


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """The frame as a Parquet table in the shared folder: a cut in the lineage that survives lost executors, and what it took to make it is not done again by those that read it.

    It goes with the ``scratch`` scope at hand (``keep``: with the one around it); without a scope it stays, for the clean-up of that folder.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    owners = _scratch.get()[:-1] if keep else _scratch.get()
    if owners:
        owners[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A small table dealt to all cores, for costly work on its rows: one of few row groups would leave most cores idle. A table with as many splits as cores is left as it is."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes")) else df


def _bytes(text: str) -> int:
    digits = str(text).lower().removesuffix("b")
    scale = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    return int(digits[:-1]) * scale[digits[-1]] if digits[-1:] in scale else int(digits)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package: where it is neither on PYTHONPATH nor in the working folder, a zip of it goes out once a context."""
    root = Path(__file__).resolve().parent.parent
    known = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]
    context = spark.sparkContext
    if context.applicationId in _shipped or any(x and Path(x).resolve() == root for x in known):
        return
    folder = tempfile.mkdtemp(prefix="sheaf-")
    context.addPyFile(shutil.make_archive(f"{folder}/sheaf", "zip", root, Path(__file__).resolve().parent.name))
    _shipped.add(context.applicationId)
