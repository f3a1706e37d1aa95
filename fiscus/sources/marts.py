"""Summary tables: filled on first use, never filled twice.

A mart is a folder of Parquet files of a fixed layout. A null ``tax_type`` is the row for all
regimes, so keys are compared null-safely. Writers are single jobs: Spark's committer makes
the new files visible together, and because rows that are already there are left out, a run
that is repeated after a failure adds only what is missing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fiscus.operators import aggregates as A
from fiscus.operators import sketches
from fiscus.operators.filters import align_schema, summary_rows
from fiscus.operators.joins import rows_absent_from
from fiscus.operators.naming import GROWTH_MART, MEDIAN_MART, PREDICTED
from fiscus.schemas import (
    MEASURES,
    MEDIAN_SKETCHES,
    MODEL_METRICS,
    MONTHLY_MEDIAN,
    PREDICT,
    YEARLY_GROWTH,
)
from fiscus.session import materialize
from fiscus.sources.commits import CommitConflict, Tables

GROWTH_KEYS = ("yr", "tax_type")
MEDIAN_KEYS = ("yr", "mon", "tax_type")


def stored_rows(spark: SparkSession, path: str, schema: StructType) -> DataFrame | None:
    """The stored rows, or None when nothing has been stored yet."""
    try:
        # A partition column is read last; put the columns back in their declared order.
        return spark.read.schema(schema).parquet(path).select(*schema.names)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def open_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    rows = stored_rows(spark, path, schema)
    return spark.createDataFrame([], schema) if rows is None else rows


def merge_absent(
    rows: DataFrame, path: str, schema: StructType, keys: Sequence[str]
) -> DataFrame:
    """Append the rows whose key is not stored yet, then read the table back.

    One anti-join replaces a look-up per row. Stored rows are never changed.
    """
    spark = rows.sparkSession
    new, present = align_schema(rows, schema), stored_rows(spark, path, schema)
    if present is not None:
        new = rows_absent_from(new, present, keys)
    new.write.mode("append").parquet(path)
    return open_table(spark, path, schema)


def refresh(rows: DataFrame, path: str, schema: StructType) -> DataFrame:
    """Replace the whole mart; ``rows`` must not be read from it."""
    align_schema(rows, schema).write.mode("overwrite").parquet(path)
    return open_table(rows.sparkSession, path, schema)


def yearly_growth_rows(
    real: DataFrame, predicted: DataFrame, mode: str, stored: bool = False
) -> DataFrame:
    """Rows of a growth mart. A growth that is not defined is stored as 0.

    ``stored`` says that both inputs are plain tables, cheap to scan again.
    """
    rows = A.yearly_growth(real, predicted, mode, stored)
    back = {name: stored for stored, name in GROWTH_MART.items()}
    return rows.na.fill(0.0, [f"{m}_growth" for m in MEASURES]).withColumnsRenamed(back)


def monthly_median_rows(
    real: DataFrame, predicted: DataFrame, stored: bool = False
) -> DataFrame:
    """Monthly medians over recorded and predicted rows pooled together."""
    medians = A.by_type_with_total(A.pooled(real, predicted), "median", ["yr", "mon"], stored)
    back = {name: stored for stored, name in MEDIAN_MART.items()}
    return medians.withColumnsRenamed(back).withColumn("created_at", F.current_timestamp())


def summary_or_fill(
    spark: SparkSession,
    path: str,
    schema: StructType,
    keys: Sequence[str],
    rows: Callable[[], DataFrame],
    tax_type: str | None = None,
    start_year: int | None = None,
    end_year: int | None = None,
) -> DataFrame:
    """Look the mart up; when it has nothing, fill it and look again.

    The fill computes every regime in one pass, so asking for another regime later finds
    its rows already there.
    """
    by_month = "mon" in keys

    def look(mart: DataFrame) -> DataFrame:
        return summary_rows(mart, tax_type, start_year, end_year, by_month)

    mart = stored_rows(spark, path, schema)
    if mart is not None:
        found = look(mart)
        if not found.isEmpty():
            return found
    return look(merge_absent(rows(), path, schema, keys))


def growth_summary(
    real: DataFrame,
    predicted: DataFrame,
    path: str,
    mode: str = "sum",
    tax_type: str | None = None,
    start_year: int | None = None,
    end_year: int | None = None,
    stored: bool = False,
) -> DataFrame:
    found = summary_or_fill(
        real.sparkSession, path, YEARLY_GROWTH, GROWTH_KEYS,
        lambda: yearly_growth_rows(real, predicted, mode, stored),
        tax_type, start_year, end_year,
    )
    return found.withColumnsRenamed(GROWTH_MART)


def monthly_median_summary(
    real: DataFrame,
    predicted: DataFrame,
    path: str,
    tax_type: str | None = None,
    start_year: int | None = None,
    end_year: int | None = None,
    stored: bool = False,
) -> DataFrame:
    found = summary_or_fill(
        real.sparkSession, path, MONTHLY_MEDIAN, MEDIAN_KEYS,
        lambda: monthly_median_rows(real, predicted, stored), tax_type, start_year, end_year,
    )
    return found.withColumnsRenamed(MEDIAN_MART)


#: The two growth marts, which are filled in one commit, and how each is aggregated.
GROWTH_MARTS = {"yearly_growth_general": "sum", "yearly_growth_median": "median"}


def fill_growth_marts(real: DataFrame, predicted: DataFrame, root: str, stored: bool = False) -> Tables:
    """Sums and medians with their growth: both marts get what they lack, or neither changes."""
    marts = Tables(real.sparkSession, root)
    rows = {name: materialize(yearly_growth_rows(real, predicted, mode, stored), name) for name, mode in GROWTH_MARTS.items()}
    marts.merge_absent(rows, dict.fromkeys(rows, YEARLY_GROWTH), GROWTH_KEYS)
    return marts


def fill_years(
    marts: Tables, name: str, schema: StructType, years: Iterable[int],
    rows: Callable[[list[int], DataFrame], DataFrame], tries: int = 10,
) -> list[int]:
    """Add the years a mart does not have; the years that were worked out.

    A year is stored whole or not at all, in one commit, so what is absent is known from the years of
    the mart alone. ``rows`` gets the absent years and the stored rows, and reads facts of those years
    only. A writer that comes second looks again.
    """
    for _ in range(tries):
        version = marts.version()
        there = marts.read(name, schema, version)
        # A mart has few rows for each year.
        absent = sorted(set(years) - {r["yr"] for r in there.select("yr").distinct().collect()})
        if not absent:
            return []
        try:
            marts.append({name: align_schema(rows(absent, there), schema)}, version)
            return absent
        except CommitConflict:
            continue
    raise CommitConflict(f"{tries} other commits came first")


def _of_years(real: DataFrame, predicted: DataFrame, years: list[int]) -> DataFrame:
    """Facts of some years; of tables stored by year no other folder is opened."""
    wanted = F.col("yr").isin(years)
    return A.pooled(real.where(wanted), predicted.where(wanted))


def fill_growth_years(
    marts: Tables, real: DataFrame, predicted: DataFrame, years: Iterable[int], mode: str = "sum", stored: bool = False
) -> list[int]:
    """Figures and growth of the absent years; the year before comes from the mart, not from facts."""
    name = next(n for n, m in GROWTH_MARTS.items() if m == mode)

    def rows(absent: list[int], there: DataFrame) -> DataFrame:
        keys = ["yr", "tax_type"]
        new = A.by_type_with_total(_of_years(real, predicted, absent), mode, ["source", "yr"], stored)
        new = new.groupBy(*keys).agg(F.min_by(F.struct(*MEASURES), "source").alias("row")).select(*keys, "row.*")
        before = there.withColumnsRenamed(GROWTH_MART).select(*keys, *MEASURES)
        both = A.growth(new.withColumn("transactions", F.col("transactions").cast("double")).unionByName(before), by=["tax_type"])
        back = {name: stored for stored, name in GROWTH_MART.items()}
        grown = both.where(F.col("yr").isin(absent)).na.fill(0.0, [f"{m}_growth" for m in MEASURES])
        return grown.withColumnsRenamed(back)

    return fill_years(marts, name, YEARLY_GROWTH, years, rows)


def fill_median_years(
    marts: Tables, real: DataFrame, predicted: DataFrame, years: Iterable[int], stored: bool = False
) -> list[int]:
    """Monthly medians of the absent years."""
    wanted = F.col("yr")
    return fill_years(
        marts, "monthly_median", MONTHLY_MEDIAN, years,
        lambda absent, there: monthly_median_rows(real.where(wanted.isin(absent)), predicted.where(wanted.isin(absent)), stored),
    )


def fill_sketch_years(marts: Tables, real: DataFrame, predicted: DataFrame, years: Iterable[int]) -> list[int]:
    """One quantile sketch a measure, year, month and regime; coarser medians merge them later."""
    keys = ["yr", "mon", "tax_type"]
    return fill_years(
        marts, "median_sketches", MEDIAN_SKETCHES, years,
        lambda absent, there: sketches.sketched(_of_years(real, predicted, absent), keys),
    )


def sketched_medians(marts: Tables, keys: Sequence[str] = ("yr",)) -> DataFrame:
    """Approximate medians per regime and over all, at any coarser grouping; facts are not read."""
    stored = marts.read("median_sketches", MEDIAN_SKETCHES)
    return sketches.medians(sketches.by_type_with_total(stored, list(keys)), [*keys, "tax_type"])


def replace_year(forecast: DataFrame, path: str) -> DataFrame:
    """Store a forecast, replacing exactly the years it covers.

    The table is partitioned by year and only the partitions that are written are swapped,
    in one job, so there is no moment at which the old year is gone and the new one absent.
    """
    rows = align_schema(forecast.withColumnsRenamed(PREDICTED), PREDICT)
    (
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("yr")
        .parquet(path)
    )
    return open_table(forecast.sparkSession, path, PREDICT)


def append_model_metrics(
    metrics: DataFrame,
    path: str,
    model_name: str,
    target_name: str,
    dataset_type: str = "test",
    model_version: str = "v1.0",
    tax_type: str | None = None,
) -> DataFrame:
    rows = metrics.withColumns({
        "model_name": F.lit(model_name),
        "target_name": F.lit(target_name),
        "dataset_type": F.lit(dataset_type),
        "model_version": F.lit(model_version),
        "tax_type": F.lit(tax_type),
        "created_at": F.current_timestamp(),
    })
    align_schema(rows, MODEL_METRICS).write.mode("append").parquet(path)
    return open_table(metrics.sparkSession, path, MODEL_METRICS)
