"""Totals, medians and growth over monthly facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fiscus.functions.scalars import percent_of
from fiscus.operators.filters import equals, where_all
from fiscus.operators.medians import exact_median
from fiscus.schemas import MEASURES
from fiscus.session import materialize

SUMMABLE = ("income", "tax", "transactions")


def totals(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sums per group. Money is added as decimals and only then turned into doubles."""
    return df.groupBy(*keys).agg(
        F.sum("income").cast("double").alias("income"),
        F.sum("transactions").cast("long").alias("transactions"),
        F.sum("tax").cast("double").alias("tax"),
    )


def aggregate(
    df: DataFrame,
    keys: Sequence[str],
    mode: str = "sum",
    bounded_by_key: bool = False,
    stored: bool = False,
) -> DataFrame:
    """Sum or median of the measures; the last two options are those of ``exact_median``."""
    if mode == "sum":
        return totals(df, keys)
    if mode == "median":
        return exact_median(df, keys, MEASURES, bounded_by_key=bounded_by_key, stored=stored)
    raise ValueError(f"mode must be 'sum' or 'median', not {mode!r}")


def yearly(
    df: DataFrame, mode: str = "sum", by: Sequence[str] = (), stored: bool = False
) -> DataFrame:
    return aggregate(df, [*by, "yr"], mode, stored=stored)


def monthly(
    df: DataFrame, mode: str = "sum", by: Sequence[str] = (), stored: bool = False
) -> DataFrame:
    return aggregate(df, [*by, "yr", "mon"], mode, stored=stored)


def yearly_by_payer(history: DataFrame, mode: str = "sum") -> DataFrame:
    """Per payer and year; the fact grain bounds a group to twelve months of each regime."""
    return aggregate(history, ["inn", "yr"], mode, bounded_by_key=True)


def by_type_with_total(
    facts: DataFrame,
    mode: str = "sum",
    keys: Sequence[str] = ("yr",),
    stored: bool = False,
) -> DataFrame:
    """Per regime, plus a row with a null regime for all of them together.

    Sums: the rows are grouped once per regime and the totals come from that small result,
    so the facts are not duplicated. Medians do not add up, so there each fact counts in
    its regime and in the total. Facts without a regime count in the total only.
    """
    keys = list(keys)
    if mode == "sum":
        parts = facts.groupBy(*keys, "tax_type").agg(*[F.sum(m).alias(m) for m in MEASURES])
        wanted = [[F.col(k) for k in keys], [*[F.col(k) for k in keys], F.col("tax_type")]]
        return (
            parts.groupingSets(wanted, *keys, "tax_type")
            .agg(
                F.sum("income").cast("double").alias("income"),
                F.sum("transactions").cast("long").alias("transactions"),
                F.sum("tax").cast("double").alias("tax"),
                F.grouping("tax_type").alias("is_total"),
            )
            .where((F.col("is_total") == 1) | F.col("tax_type").isNotNull())
            .drop("is_total")
        )
    if not stored:
        facts = materialize(facts.select(*keys, "tax_type", *MEASURES), "median-input")
    counted_in = F.when(
        F.col("tax_type").isNotNull(), F.array(F.col("tax_type"), F.lit(None))
    ).otherwise(F.array(F.lit(None).cast("string")))
    unfolded = facts.select(*keys, *MEASURES, F.explode(counted_in).alias("tax_type"))
    return aggregate(unfolded, [*keys, "tax_type"], mode, stored=True)


def growth(
    df: DataFrame, by: Sequence[str] = (), measures: Sequence[str] = MEASURES
) -> DataFrame:
    """Percent change against the previous year that has a row.

    Null on the first row and on a zero base. Works on yearly rows, so a window partition
    is as long as the number of years.
    """
    order = Window.partitionBy(*by).orderBy("yr")
    return df.withColumns({
        f"{m}_growth": percent_of(
            (F.col(m) - F.lag(m).over(order)).cast("double"),
            F.lag(m).over(order).cast("double"),
        )
        for m in measures
    })


def real_over_predicted(real: DataFrame, predicted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Both sets of yearly rows; where a key is in both, the recorded row wins."""
    ranked = real.withColumn("source", F.lit(0)).unionByName(
        predicted.withColumn("source", F.lit(1))
    )
    names = [c for c in real.columns if c not in keys]
    return (
        ranked.groupBy(*keys)
        .agg(F.min_by(F.struct(*names), "source").alias("row"))
        .select(*keys, "row.*")
    )


def pooled(real: DataFrame, predicted: DataFrame) -> DataFrame:
    """Recorded (``source`` 0) and predicted (``source`` 1) rows, all amounts in cents."""
    columns = ["yr", "mon", "tax_type", *MEASURES]

    def amounts(df: DataFrame, source: int) -> DataFrame:
        return df.select(*columns).withColumns({
            "income": F.col("income").cast("decimal(18,2)"),
            "tax": F.col("tax").cast("decimal(18,2)"),
            "source": F.lit(source),
        })

    return amounts(real, 0).unionByName(amounts(predicted, 1))


def yearly_growth(
    real: DataFrame, predicted: DataFrame, mode: str = "sum", stored: bool = False
) -> DataFrame:
    """Yearly figures with growth, for each regime and for all of them (null regime).

    Both sources are aggregated in the same pass, each on its own; where a year is in both,
    the recorded figures count.
    """
    keys = ["yr", "tax_type"]
    both = by_type_with_total(pooled(real, predicted), mode, ["source", "yr"], stored)
    first = F.min_by(F.struct(*MEASURES), "source").alias("row")
    return growth(both.groupBy(*keys).agg(first).select(*keys, "row.*"), by=["tax_type"])


def payer_count(payers: DataFrame, taxpayer_type: str | None = None) -> DataFrame:
    return where_all(payers, equals("taxpayer_type", taxpayer_type)).agg(
        F.count(F.lit(1)).alias("count")
    )


def distinct_years(facts: DataFrame) -> DataFrame:
    return facts.select("yr").distinct().orderBy("yr")


def last_year(facts: DataFrame) -> DataFrame:
    return facts.agg(F.max("yr").alias("max_year"))


def year_range(facts: DataFrame) -> DataFrame:
    """First, last and all years; the list is gathered from already distinct years."""
    years = facts.select("yr").distinct()
    return years.agg(
        F.min("yr").alias("min_year"),
        F.max("yr").alias("max_year"),
        F.array_sort(F.collect_list("yr")).alias("years"),
    ).where(F.col("min_year").isNotNull())


def latest_year_total(
    facts: DataFrame, column: str, tax_type: str | None = None
) -> DataFrame:
    """Sum of one measure over the last year that has facts; 0 when there is nothing."""
    if column not in SUMMABLE:
        raise ValueError(f"cannot total {column!r}")
    rows = facts.where(F.col("yr") == last_year(facts).scalar())
    return where_all(rows, equals("tax_type", tax_type)).agg(
        F.coalesce(F.sum(column).cast("double"), F.lit(0.0)).alias("total")
    )


def payer_year_summary(
    monthly_forecast: DataFrame, measures: Sequence[str] = MEASURES
) -> DataFrame:
    """Yearly sums per payer; rows without an id, name or INN belong to no payer."""
    keys = ["taxpayer_id", "full_name", "inn"]
    return (
        monthly_forecast.dropna(subset=keys)
        .groupBy(*keys, "yr")
        .agg(*[F.sum(m).alias(f"total_predicted_{m}") for m in measures])
    )


def month_profile(predictions: DataFrame, mode: str = "sum", stored: bool = False) -> DataFrame:
    """Predictions by calendar month, over all predicted years."""
    return aggregate(predictions, ["mon"], mode, stored=stored)


def distinct_payers(facts_of_payers: DataFrame) -> DataFrame:
    """Payers as the set of their attributes and regimes, without the id."""
    return facts_of_payers.select(
        "full_name", "inn", "taxpayer_type", "activity_type", "registration_district",
        "has_employees", "employees_count", "tax_type",
    ).distinct()


def share_by(df: DataFrame, key: str) -> DataFrame:
    """Count and percentage of rows per value; the total comes from the counts."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.withColumn(
        "share_pct", F.lit(100.0) * F.col("n") / total.scalar()
    )
