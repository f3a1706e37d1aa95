"""Answers about stored facts from the names of their folders, without opening a file.

``tables.write_facts`` stores one folder for each year, so which years there are is known from a list
of names, whatever the number of facts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fiscus.sources import files


def stored_years(spark: SparkSession, path: str) -> list[int]:
    """Years that have facts; a folder without a data file has none."""
    found = []
    for name in files.names(spark, path):
        if name.startswith("yr=") and name[3:].isdigit() and any(not n.startswith((".", "_")) for n in files.names(spark, f"{path}/{name}")):
            found.append(int(name[3:]))
    return sorted(found)


def _rows(spark: SparkSession, text: str) -> DataFrame:
    """A relation of literals: no scan and no exchange."""
    return spark.sql(f"select {text}")


def _year(value: int | None) -> str:
    return f"cast({'null' if value is None else value} as int)"


def _array(years: list[int]) -> str:
    return f"cast(array({', '.join(map(str, years))}) as array<int>)"


def distinct_years(spark: SparkSession, path: str) -> DataFrame:
    """The years in order."""
    return _rows(spark, f"explode({_array(stored_years(spark, path))}) as yr")


def last_year(spark: SparkSession, path: str) -> DataFrame:
    """One row; null when nothing is stored."""
    return _rows(spark, f"{_year(max(stored_years(spark, path), default=None))} as max_year")


def year_range(spark: SparkSession, path: str) -> DataFrame:
    """First, last and all years; no row when nothing is stored."""
    years = stored_years(spark, path)
    ends = f"{_year(min(years, default=None))} as min_year, {_year(max(years, default=None))} as max_year"
    rows = _rows(spark, f"{ends}, {_array(years)} as years")
    return rows if years else rows.limit(0)


def freshness(spark: SparkSession, real: str, predicted: str) -> DataFrame:
    """Last recorded and last predicted year, and whether the forecast must be remade."""
    last, coming = (max(stored_years(spark, p), default=None) for p in (real, predicted))
    stale = last is not None and (coming is None or coming <= last)
    return _rows(spark, f"{_year(last)} as last_real_year, {_year(coming)} as last_predicted_year, {str(stale).lower()} as stale")
