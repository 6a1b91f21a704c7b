"""Row numbers over many rows: sorted ranges are written once, their sizes are summed up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheaf.session import written

#: ``monotonically_increasing_id`` holds the partition above these bits and the row's place in it below.
_BITS = 33


def ranged(df: DataFrame, sort: list[str | Column]) -> DataFrame:
    """Rows in the given order (nulls first) as sorted ranges, written once, with ``_place``: the range (see ``range_of_place``), then the place in it.

    The rows are written before they are dealt too: Spark reads them once for the borders and once more to deal them, and would make them twice.
    """
    sort = [*sort, "_tie"]
    dealt = written(df, "rows").withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*sort).sortWithinPartitions(*sort)
    return written(dealt.drop("_tie").withColumn("_place", F.monotonically_increasing_id()), "ranges")


def range_of_place(place: str = "_place") -> Column:
    return F.shiftright(place, _BITS)


def numbered(df: DataFrame, order: list[str | Column], by: tuple[str, ...] = (), name: str = "_k") -> DataFrame:
    """Rows with their number from 0 in the given order (nulls first), in all or in each group ``by``.

    Rows are dealt into as many sorted ranges as the session has shuffle partitions, equal rows over several ranges where they are many, and
    written once, since another run would cut other ranges. A row's number is its place in its range after the rows of the ranges before;
    a group's numbers begin at its first row. So no task sees all rows or a large group, rows are shuffled once, and what is
    summed up in one task is a row a range (and a row a group in many).
    """
    held = ranged(df, [*by, *order])
    part = range_of_place()
    sizes = held.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row a range: as many as a shuffle has partitions
    starts = F.broadcast(sizes.select(F.col("_part").alias("_at"), before.alias("_before")))
    out = held.join(starts, part == F.col("_at")).withColumn(name, (F.col("_before") + F.col("_place").bitwiseAND((1 << _BITS) - 1)).cast("long"))
    if by:
        first = out.groupBy(*(F.col(c).alias(f"_{c}") for c in by)).agg(F.min(name).alias("_first"))
        same = F.lit(True)
        for c in by:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        out = out.join(first, same).withColumn(name, F.col(name) - F.col("_first"))
    return out.drop("_place", "_at", "_before", "_first", *(f"_{c}" for c in by))
