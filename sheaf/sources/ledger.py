"""Calls that are paid or slow, made once: requests by hash in a stored table of replies.

``replies`` asks only for requests that the ledger lacks, each once whatever the number of rows that hold it, a few at a time in each task and again where
a call fails. Replies are committed in rounds, so a job that dies keeps those of the rounds before, and the next run goes on from there. A
request that fails for good has no reply and is asked again by the next run.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.session import ship, written

from . import keyed

RETRIES, AT_ONCE = 2, 4
#: Requests that are committed together.
ROUND = 100_000
_SCHEMA = "hash string, request string, reply string, attempts int"


def request_hash(request):
    return F.sha2(request.cast("binary"), 256)


def known(spark: SparkSession, path: str) -> DataFrame:
    """``hash, request, reply, attempts`` of the calls that were answered."""
    return keyed.read(spark, path, _SCHEMA)


def replies(requests: DataFrame, path: str, call: Callable[[str], str], request: str = "request", retries: int = RETRIES, at_once: int = AT_ONCE, round_size: int = ROUND) -> DataFrame:
    """``requests`` with ``reply``, null where the call failed or the request is null. ``call`` takes a request's text, on the executors, in threads."""
    spark = requests.sparkSession
    ship(spark)
    wanted = requests.select(F.col(request).alias("request")).where(F.col("request").isNotNull()).distinct().withColumn("hash", request_hash(F.col("request")))
    missing = written(wanted.join(known(spark, path), "hash", "left_anti").select("hash", "request"), "missing")
    rounds = -(-missing.count() // round_size)

    def ask(batches):
        import time
        from concurrent.futures import ThreadPoolExecutor

        def one(text: str) -> tuple[str | None, int]:
            for attempt in range(1, retries + 2):
                try:
                    return call(text), attempt
                except Exception:  # noqa: BLE001  a failing call must not fail the others
                    time.sleep(min(5.0, 0.05 * 2**attempt) if attempt <= retries else 0)
            return None, retries + 1

        with ThreadPoolExecutor(at_once) as pool:
            for b in batches:
                got = list(pool.map(one, b.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r for r, _ in got], pa.string()), pa.array([n for _, n in got], pa.int32())], ["hash", "request", "reply", "attempts"])

    for k in range(rounds):
        part = missing.where(F.pmod(F.xxhash64("hash"), F.lit(rounds)) == k)
        done = written(part.mapInArrow(ask, _SCHEMA), "answered")  # asked once, whatever reads it
        keyed.append(done.where(F.col("reply").isNotNull()), path, ["hash"])
    found = known(spark, path).select(F.col("hash").alias("_hash"), "reply")
    return requests.withColumn("_asked", request_hash(F.col(request))).join(found, F.col("_asked") == F.col("_hash"), "left").drop("_asked", "_hash")
