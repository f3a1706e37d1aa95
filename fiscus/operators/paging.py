"""Sorted pages of payers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fiscus.functions.scalars import ceil_div
from fiscus.operators.filters import contains, equals, where_all

SORTABLE = (
    "taxpayer_id", "full_name", "inn", "registration_district", "has_employees",
    "employees_count",
)


def order_columns(sort_by: str = "taxpayer_id", sort_order: str = "asc") -> list[Column]:
    """An allow-listed column, then the id, which breaks ties so that pages never overlap."""
    if sort_by not in SORTABLE:
        raise ValueError(f"cannot sort by {sort_by!r}")
    direction = sort_order.upper()
    if direction not in ("ASC", "DESC"):
        raise ValueError(f"unknown sort order {sort_order!r}")
    # Nulls first going up and last going down, as the source database does.
    column = F.col(sort_by)
    first = column.asc_nulls_first() if direction == "ASC" else column.desc_nulls_last()
    return [first, F.col("taxpayer_id").asc()]


def order_by(df: DataFrame, sort_by: str = "taxpayer_id", sort_order: str = "asc") -> DataFrame:
    return df.orderBy(*order_columns(sort_by, sort_order))


def page_of(df: DataFrame, page: int = 1, page_size: int = 10) -> DataFrame:
    """Slice of a sorted frame. Sort, offset and limit fuse into one per-partition top-n."""
    if page < 1 or page_size < 1:
        raise ValueError("page and page_size start at 1")
    return df.offset((page - 1) * page_size).limit(page_size)


def page_after(
    df: DataFrame,
    last_id: int | None = None,
    page_size: int = 10,
    sort_by: str = "taxpayer_id",
    sort_order: str = "asc",
    last_value=None,
) -> DataFrame:
    """Next page from the last row seen, its value and its id: the cost does not grow with depth."""
    rows = df
    if last_id is not None:
        column, later = F.col(sort_by), F.col("taxpayer_id") > F.lit(last_id)
        up = sort_order.upper() == "ASC"
        if sort_by == "taxpayer_id":
            after = later if up else F.col("taxpayer_id") < F.lit(last_id)
        elif last_value is None:
            after = column.isNull() & later
            if up:
                after = after | column.isNotNull()
        else:
            value = F.lit(last_value)
            after = (column > value if up else column < value) | ((column == value) & later)
            if not up:
                after = after | column.isNull()
        rows = df.where(after)
    return order_by(rows, sort_by, sort_order).limit(page_size)


def with_total(rows: DataFrame, counted: DataFrame) -> DataFrame:
    """Carry the size of ``counted`` on each row.

    A window count over everything would pull the table into one task; a scalar subquery
    is an ordinary distributed count.
    """
    total = counted.agg(F.count(F.lit(1)).alias("total_count"))
    return rows.withColumn("total_count", total.scalar())


def payer_page(
    payers: DataFrame,
    page: int = 1,
    page_size: int = 10,
    inn: str | None = None,
    district: str | None = None,
    sort_by: str = "taxpayer_id",
    sort_order: str = "asc",
) -> DataFrame:
    """Filtered, sorted page with the total and the page count on each row."""
    found = where_all(
        payers.select(*SORTABLE),
        contains("inn", inn),
        equals("registration_district", district or None),
    )
    rows = with_total(page_of(order_by(found, sort_by, sort_order), page, page_size), found)
    return rows.withColumn("total_pages", ceil_div(F.col("total_count"), page_size))


def page_summary(
    payers: DataFrame, page_size: int = 10, inn: str | None = None, district: str | None = None
) -> DataFrame:
    """Total and page count alone: still right when the page asked for is past the end."""
    found = where_all(
        payers, contains("inn", inn), equals("registration_district", district or None)
    )
    return found.agg(F.count(F.lit(1)).alias("total")).withColumn(
        "total_pages", ceil_div(F.col("total"), page_size)
    )
