"""Tables by path, by SQL text and over JDBC."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def read_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A stored table with its declared columns; nothing is inferred from the files."""
    return spark.read.schema(schema).parquet(path)


def write_facts(facts: DataFrame, path: str) -> None:
    """Store monthly facts by year, each file holding a narrow range of payers.

    Year ranges then open only the folders they need, and a look-up of one payer only the
    row groups whose range covers its id. Ranges are cut by row count, so neither a large
    year nor a busy payer makes a large task.
    """
    ranged = facts.repartitionByRange("yr", "taxpayer_id")
    ordered = ranged.sortWithinPartitions("yr", "taxpayer_id")
    ordered.write.mode("overwrite").partitionBy("yr").parquet(path)


def write_payers(payers: DataFrame, path: str, group_bytes: int = 8 << 20) -> None:
    """Store payers in ranges of their INN, with a bloom filter on it in each row group.

    A look-up of one INN reads the row groups whose range holds it, and of these only the ones whose
    filter does not rule it out. ``group_bytes``: size of a row group.
    """
    (
        payers.repartitionByRange("inn", "taxpayer_id").sortWithinPartitions("inn", "taxpayer_id")
        .write.mode("overwrite")
        .option("parquet.bloom.filter.enabled#inn", "true")
        .option("parquet.bloom.filter.adaptive.enabled", "true")
        .option("parquet.block.size", str(group_bytes))
        .parquet(path)
    )


def run_sql(
    spark: SparkSession,
    query: str,
    args: Mapping[str, object] | Sequence[object] | None = None,
    **frames: DataFrame,
) -> DataFrame:
    """SQL with bound parameters (``:name`` or ``?``); ``{name}`` stands for a frame.

    Values are never spliced into the text. A failing query raises.
    """
    return spark.sql(query, args=args, **frames)


def monthly_source(tables, source: str) -> DataFrame:
    """The recorded (``real``) or the predicted (``predict``) monthly rows."""
    if source == "real":
        return tables.monthly_tax
    if source == "predict":
        return tables.predict
    raise ValueError(f"source must be 'real' or 'predict', not {source!r}")


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    split_by: str,
    lower: int,
    upper: int,
    splits: int,
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """A database table read as ``splits`` parallel ranges of a numeric column.

    The bounds only shape the ranges; rows outside them are read too.
    """
    reader = spark.read.format("jdbc").options(
        url=url,
        dbtable=table,
        partitionColumn=split_by,
        lowerBound=str(lower),
        upperBound=str(upper),
        numPartitions=str(splits),
    )
    return reader.options(**dict(options or {})).load()


def append_jdbc(
    df: DataFrame, url: str, table: str, batch: int = 100_000,
    options: Mapping[str, str] | None = None,
) -> None:
    """Append to a database table in batches, one connection per partition."""
    writer = df.write.format("jdbc").options(url=url, dbtable=table, batchsize=str(batch))
    writer.options(**dict(options or {})).mode("append").save()
