"""Sorted tables whose pages are found by number: page N is opened where it is, without a sort.

A sorted table is stored in ranges, one folder each, every row with its place in its range. A small
directory holds the number of rows of each range and of those before it, so the rows of a page are
known by range and place, and nothing else is opened.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from fiscus.functions.scalars import ceil_div
from fiscus.operators.ranks import PART, ROW, directory, in_ranges


def write_ranked(df: DataFrame, order: Sequence[Column], path: str, parts: int | None = None) -> None:
    """Store ``df`` in an order that the columns settle, and its directory."""
    in_ranges(df, order, parts).write.partitionBy(PART).parquet(f"{path}/rows")
    stored = df.sparkSession.read.schema(_stored(df.schema)).parquet(f"{path}/rows")
    # Only row counts of the files are read here.
    directory(stored.select(PART)).write.parquet(f"{path}/directory")


def _stored(schema: StructType) -> StructType:
    return StructType([*schema.fields]).add(ROW, LongType()).add(PART, IntegerType())


def ranked_page(spark: SparkSession, path: str, schema: StructType, page: int = 1, page_size: int = 10) -> DataFrame:
    """Rows of a page in order, with the total and the page count on each row."""
    if page < 1 or page_size < 1:
        raise ValueError("page and page_size start at 1")
    start, end = (page - 1) * page_size, page * page_size
    ranges = spark.read.schema("part int, rows long, before long").parquet(f"{path}/directory")
    total = ranges.agg(F.sum("rows")).first()[0] or 0
    # No range is empty, so a page touches at most as many ranges as it has rows.
    hits = ranges.where((F.col("before") < end) & (F.col("before") + F.col("rows") > start)).collect()
    rows = spark.read.schema(_stored(schema)).parquet(f"{path}/rows")
    if not hits:
        rows = rows.limit(0)
    else:
        wanted = F.lit(False)
        for h in hits:
            wanted = wanted | ((F.col(PART) == h["part"]) & F.col(ROW).between(max(start - h["before"], 0), end - h["before"] - 1))
        rows = rows.where(F.col(PART).isin([h["part"] for h in hits]) & wanted).orderBy(PART, ROW).limit(page_size)
    counted = rows.select(*schema.names).withColumn("total_count", F.lit(total).cast("long"))
    return counted.withColumn("total_pages", ceil_div(F.col("total_count"), page_size))
