"""Row selection and projection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fiscus.functions.scalars import avatar_url

PROFILE = (
    "taxpayer_id", "full_name", "passport_number", "inn", "taxpayer_type",
    "activity_type", "registration_district", "has_employees", "employees_count",
)
MODEL_FEATURES = (
    "yr", "mon", "season", "tax_type", "taxpayer_type",
    "activity_type", "registration_district", "has_employees", "employees_count",
)


def where_all(df: DataFrame, *conditions: Column | None) -> DataFrame:
    """AND of the conditions that are present; with none, every row stays."""
    present = [c for c in conditions if c is not None]
    return df.where(reduce(Column.__and__, present)) if present else df


def equals(name: str, value) -> Column | None:
    return None if value is None else F.col(name) == F.lit(value)


def at_least(name: str, value) -> Column | None:
    return None if value is None else F.col(name) >= F.lit(value)


def at_most(name: str, value) -> Column | None:
    return None if value is None else F.col(name) <= F.lit(value)


def contains(name: str, text: str | None) -> Column | None:
    """Literal substring test: ``%`` and ``_`` in ``text`` mean themselves."""
    return F.col(name).contains(text) if text else None


def same_or_total(name: str, value) -> Column:
    """Summary-table key: no value asked for means the null (all regimes) row."""
    return F.col(name).eqNullSafe(F.lit(value))


def in_years(df: DataFrame, start_year: int | None = None, end_year: int | None = None) -> DataFrame:
    """Both ends inclusive, each optional; prunes partitions of a table stored by year."""
    return where_all(df, at_least("yr", start_year), at_most("yr", end_year))


def of_tax_type(df: DataFrame, tax_type: str | None = None) -> DataFrame:
    return where_all(df, equals("tax_type", tax_type))


def summary_rows(
    mart: DataFrame,
    tax_type: str | None = None,
    start_year: int | None = None,
    end_year: int | None = None,
    by_month: bool = False,
) -> DataFrame:
    """Rows of a summary table for one regime, or for all regimes together."""
    rows = in_years(mart.where(same_or_total("tax_type", tax_type)), start_year, end_year)
    return rows.orderBy("yr", "mon") if by_month else rows.orderBy("yr")


def monthly_rows(
    facts: DataFrame,
    tax_type: str | None = None,
    start_year: int | None = None,
    end_year: int | None = None,
) -> DataFrame:
    """Facts in month order, measures under their public names.

    Sorting by (yr, mon) alone has only as many distinct keys as there are months, so one
    busy month would land in one sort task; the payer columns let the range partitioner
    split it without changing the order that was asked for.
    """
    rows = in_years(of_tax_type(facts, tax_type), start_year, end_year)
    return rows.orderBy("yr", "mon", "taxpayer_id", "tax_type").select(
        "yr",
        "mon",
        F.col("income").alias("total_income"),
        F.col("transactions").alias("total_transactions"),
        F.col("tax").alias("total_tax"),
    )


def payer_by_inn(payers: DataFrame, inn: str) -> DataFrame:
    return payers.where(F.col("inn") == F.lit(inn))


def profile_by_inn(payers: DataFrame, inn: str) -> DataFrame:
    return payer_by_inn(payers, inn).select(*PROFILE)


def normalize_types(payers: DataFrame) -> DataFrame:
    """Id as long, has_employees as boolean, employees_count as int or null; no row loop."""
    return payers.withColumns({
        "taxpayer_id": F.col("taxpayer_id").cast("long"),
        "has_employees": F.col("has_employees").cast("boolean"),
        "employees_count": F.col("employees_count").try_cast("int"),
    })


def user_records(payers: DataFrame, *extra: str) -> DataFrame:
    """The user card of a payer, and ``extra`` columns as they are.

    A head count of 0 is shown as 'none'.
    """
    return payers.select(
        F.col("taxpayer_id").alias("id"),
        F.col("full_name").alias("name"),
        "inn",
        "registration_district",
        "has_employees",
        F.nullif(F.col("employees_count"), F.lit(0)).alias("employees_count"),
        F.struct(avatar_url(F.col("full_name")).alias("src")).alias("avatar"),
        *extra,
    )


def model_features(df: DataFrame) -> DataFrame:
    return df.select(*MODEL_FEATURES)


def align_schema(df: DataFrame, schema: StructType) -> DataFrame:
    """Exactly the columns of ``schema``: missing ones as null, extra ones dropped."""
    present = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ])


def json_records(df: DataFrame) -> DataFrame:
    """One JSON object per row; nulls are kept as ``null`` and dates are ISO text."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("record"))
