"""Order of a whole table without sorting it in one task.

Rows are dealt into ranges of the sort columns, each range is sorted where it is, and what a row needs
to know of the ranges before its own comes from one small row for each range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fiscus.session import materialize

#: Number of the range a row is in, and its place there, from 0.
PART, ROW = "part", "row"


def in_ranges(df: DataFrame, order: Sequence[Column], parts: int | None = None) -> DataFrame:
    """Rows sorted within ranges, with the range's number and the place in it.

    The last sort columns should settle ties: equal rows share a range.
    """
    dealt = df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)
    # Sorted by the number of the range first, so that a writer that divides by it need not sort again.
    rows = dealt.withColumn(PART, F.spark_partition_id()).sortWithinPartitions(PART, *order)
    # Rows of a task are numbered in their order in the lower 33 bits.
    return rows.withColumn(ROW, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))


def directory(rows: DataFrame) -> DataFrame:
    """(part, rows, before) of rows in ranges: how many rows there are, and in the ranges before."""
    counts = rows.groupBy(PART).agg(F.count(F.lit(1)).alias("rows"))
    # One row for each range, so this window is as small as the list of files.
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0)))


def with_rank(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """The place of each row in the whole order, from 0. The sorted rows are stored once."""
    rows = materialize(in_ranges(df, order), "ranked")
    return rows.join(directory(rows).select(PART, "before"), PART).withColumn(
        name, F.col("before") + F.col(ROW)
    ).drop(PART, ROW, "before")


def last_seen(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """``value`` filled with the last one that is not null, in ``order``, per key.

    ``keys`` and ``order`` together must settle the order. A key may hold any share of the rows: it is
    cut into ranges, and each range is told the last value of the ranges before it.
    """
    columns = [F.col(k) for k in keys]
    rows = materialize(in_ranges(df, [*columns, F.col(order)]).drop(ROW), "ranges")
    within = Window.partitionBy(PART, *columns).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.groupBy(PART, *columns).agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("end")
    )
    # A key has at most one row for each range here.
    earlier = Window.partitionBy(*columns).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(PART, *columns, F.last("end", ignorenulls=True).over(earlier).alias("carried"))
    seen = rows.withColumn(value, F.last(value, ignorenulls=True).over(within))
    names = [PART, *keys]
    told = seen.join(carried.toDF(*[f"{n}_" for n in names], "carried"), _same(names), "left")
    return told.withColumn(value, F.coalesce(value, "carried")).select(*df.columns)


def _same(names: Sequence[str]) -> Column:
    """Null-safe equality of each name with the same name and an underscore."""
    condition = F.lit(True)
    for name in names:
        condition = condition & F.col(name).eqNullSafe(F.col(f"{name}_"))
    return condition
