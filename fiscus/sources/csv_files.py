"""CSV in and out, always with a declared schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fiscus.schemas import ECON_CSV, ECON_INDICATORS, PREDICTIONS_CSV

NO_VALUE = ".."
ECON_DATE = "MM.dd.yyyy"


def read_econ_csv(spark: SparkSession, path: str) -> DataFrame:
    """Monthly indicators keyed by (yr, mon). Columns are taken by position."""
    rows = spark.read.schema(ECON_CSV).csv(path, header=True, nullValue=NO_VALUE)
    day = F.to_date("time", ECON_DATE)
    return rows.select(F.year(day).alias("yr"), F.month(day).alias("mon"), *ECON_INDICATORS)


def write_econ_csv(econ: DataFrame, path: str) -> None:
    """The inverse of ``read_econ_csv``; indicators the frame lacks are written as no value."""
    day = F.make_date("yr", "mon", F.lit(1))
    columns = [
        (F.col(c) if c in econ.columns else F.lit(None)).cast("double").alias(c)
        for c in ECON_INDICATORS
    ]
    rows = econ.select(F.date_format(day, ECON_DATE).alias("time"), *columns)
    rows.write.csv(path, header=True, nullValue=NO_VALUE)


def read_predictions_csv(spark: SparkSession, path: str) -> DataFrame:
    """Actual and predicted values; files that call the actual value ``y_true`` read the same."""
    return spark.read.schema(PREDICTIONS_CSV).csv(path, header=True)


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV parts, each with a header; nothing is pulled into one task."""
    df.write.csv(path, header=True)
