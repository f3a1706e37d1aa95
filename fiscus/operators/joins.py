"""Joins between facts, payers and months.

No join here carries a broadcast hint on data: Spark broadcasts a side when its known or
measured size is under the session's threshold, and otherwise shuffles, splitting hot keys
(adaptive skew join).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiscus.functions.scalars import season
from fiscus.schemas import MEASURES

PAYER_ATTRIBUTES = (
    "taxpayer_id", "full_name", "inn", "taxpayer_type", "activity_type",
    "registration_district", "has_employees", "employees_count",
)


def facts_with_payers(facts: DataFrame, payers: DataFrame) -> DataFrame:
    return facts.join(payers.select(*PAYER_ATTRIBUTES), "taxpayer_id")


def payers_by_tax_type(
    facts: DataFrame, payers: DataFrame, tax_type: str | None = None
) -> DataFrame:
    """One row per payer and regime the payer has facts for.

    The regimes of a payer are gathered as a set (a handful of values) before the shuffle,
    so facts cross the network once, de-duplicated, already hashed on the join key; the
    set is unfolded after the join.
    """
    if tax_type is not None:
        facts = facts.where(F.col("tax_type") == F.lit(tax_type))
    regimes = facts.groupBy("taxpayer_id").agg(F.collect_set("tax_type").alias("regimes"))
    return payers.select(*PAYER_ATTRIBUTES).join(regimes, "taxpayer_id").select(
        *PAYER_ATTRIBUTES, F.explode("regimes").alias("tax_type")
    )


def with_months(facts: DataFrame, months: DataFrame) -> DataFrame:
    """Left join on (yr, mon); a month that is there twice gives both rows.

    A stored month table has a known size, so Spark broadcasts it while it is small.
    """
    return facts.join(months, ["yr", "mon"], "left")


def spread(payers: DataFrame) -> DataFrame:
    """Payer rows dealt over all cores by id, before they are unfolded and scored.

    The payers often come from one small file, whose split would otherwise carry the whole grid.
    An explicit count is not coalesced.
    """
    spark = payers.sparkSession
    cores = spark.sparkContext.defaultParallelism
    count = max(4 * cores, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return payers.repartition(count, "taxpayer_id")


def forecast_grid(payers: DataFrame, year: int) -> DataFrame:
    """Every payer row x the 12 months of ``year``: only the payers are shuffled."""
    return spread(payers).select(
        "*",
        F.lit(year).cast("int").alias("yr"),
        F.explode(F.sequence(F.lit(1), F.lit(12))).alias("mon"),
    ).withColumn("season", season(F.col("mon")))


def attach_scenario(df: DataFrame, scenario: Mapping[str, float]) -> DataFrame:
    return df.withColumns({name: F.lit(float(v)) for name, v in scenario.items()})


def rows_absent_from(rows: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Anti-join in which a null key equals a null key."""
    present = existing.select(*[F.col(k).alias(f"present_{k}") for k in keys])
    match = [F.col(k).eqNullSafe(F.col(f"present_{k}")) for k in keys]
    return rows.join(present, match, "left_anti")


def payer_history(
    facts: DataFrame,
    predictions: DataFrame,
    payers: DataFrame,
    inn: str | None = None,
    start_year: int | None = None,
    end_year: int | None = None,
) -> DataFrame:
    """Recorded and predicted months of a payer, or of every payer.

    For one payer the facts are first cut to the id found in the (small) payer scan. The
    id arrives as a pair of scalar subqueries, which the scan turns into literals, so the
    look-up reads only matching row groups rather than shuffling the table.
    """
    def bounded(df):
        if start_year is not None:
            df = df.where(F.col("yr") >= start_year)
        if end_year is not None:
            df = df.where(F.col("yr") <= end_year)
        return df

    measures = ["inn", "yr", "mon", "tax_type", *MEASURES]
    facts, predictions = bounded(facts), bounded(predictions)
    if inn is not None:
        payers = payers.where(F.col("inn") == F.lit(inn))
        predictions = predictions.where(F.col("inn") == F.lit(inn))
        ids = payers.agg(F.min("taxpayer_id").alias("lo"), F.max("taxpayer_id").alias("hi"))
        facts = facts.where(F.col("taxpayer_id") >= ids.select("lo").scalar())
        facts = facts.where(F.col("taxpayer_id") <= ids.select("hi").scalar())
    recorded = facts.join(payers.select("taxpayer_id", "inn"), "taxpayer_id")
    amounts = {c: F.col(c).cast("decimal(18,2)") for c in ("income", "tax")}
    return recorded.select(*measures).withColumns(amounts).unionByName(
        predictions.select(*measures).withColumns(amounts)
    )
