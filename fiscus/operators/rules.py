"""Tax rules: expected income and tax of a payer's month, anomalies, price bands.

Rule tables are left-joined on equality. They are literal relations of a known size, so the
facts stay where they are. Factors are decimals: products are exact, and rounding to cents
happens once, at the end.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fiscus.functions.lookups import (
    AVERAGE_SALARY_DEFAULT,
    FLAT_PRICE_DEFAULT,
    MAX_EXPENSE_SHARE,
    NET_INCOME_RATE,
    PATENT_RATE,
)
from fiscus.operators.intervals import with_interval

MONTHS = 12


def _dec(value: float, digits: int = 2) -> Column:
    return F.lit(value).cast(f"decimal(6,{digits})")


def workers_factor(employees: Column) -> Column:
    """Factor by head count; no recorded count means the payer works alone."""
    n = F.coalesce(employees, F.lit(0))
    return (
        F.when(n == 0, _dec(0.9))
        .when(n.between(1, 2), _dec(1.0))
        .when(n.between(3, 5), _dec(1.15))
        .when(n.between(6, 10), _dec(1.3))
        .otherwise(_dec(1.5))
    )


def with_workers_factor(df: DataFrame) -> DataFrame:
    return df.withColumn("workers_factor", workers_factor(F.col("employees_count")))


def with_district_factor(df: DataFrame, factors: DataFrame) -> DataFrame:
    """Districts that are not in the table count as 1.0."""
    known = factors.select("registration_district", F.col("factor").alias("known_factor"))
    return df.join(known, "registration_district", "left").withColumn(
        "district_factor", F.coalesce(F.col("known_factor"), _dec(1.0))
    ).drop("known_factor")


def with_seasonal_factor(
    df: DataFrame, factors: DataFrame, name: str = "seasonal_factor"
) -> DataFrame:
    known = factors.select("activity_type", "season", F.col("factor").alias(name))
    return df.join(known, ["activity_type", "season"], "left")


def with_expected_income(
    df: DataFrame,
    base: DataFrame,
    seasonal: DataFrame,
    district: DataFrame,
    use_workers: bool = True,
) -> DataFrame:
    """Base income of the activity and year, adjusted for season, district and workers.

    ``income_ratio`` is recorded over expected income; both are null where the rule tables
    say nothing about the activity and year.
    """
    rows = with_district_factor(with_seasonal_factor(df, seasonal), district)
    rows = with_workers_factor(rows).join(base, ["activity_type", "yr"], "left")
    expected = F.col("base_income") * F.col("seasonal_factor") * F.col("district_factor")
    if use_workers:
        expected = expected * F.col("workers_factor")
    return rows.withColumn("expected_income", expected.cast("double")).withColumn(
        "income_ratio", F.try_divide(F.col("income").cast("double"), F.col("expected_income"))
    )


def flat_tax(income: Column, rate: Column) -> Column:
    """Share of income in cents; nothing is due without income."""
    return F.when(income > 0, F.round(income * rate, 2)).otherwise(F.lit(0).cast("decimal(18,2)"))


def with_flat_tax(df: DataFrame, rates: DataFrame) -> DataFrame:
    """Expected tax of regimes with a flat rate; null for the others."""
    return df.join(rates, "tax_type", "left").withColumn(
        "expected_tax", F.when(F.col("rate").isNotNull(), flat_tax(F.col("income"), F.col("rate")))
    )


def net_tax(income: Column, expense_share: Column) -> Column:
    """Tax on income less expenses, which count for at most three quarters of it."""
    share = F.least(expense_share, _dec(MAX_EXPENSE_SHARE))
    net = F.greatest(income - income * share, F.lit(0))
    return F.round(net * _dec(NET_INCOME_RATE), 2)


def with_net_tax(df: DataFrame, ratios: DataFrame, seasonal: DataFrame) -> DataFrame:
    rows = with_seasonal_factor(df, seasonal, "expense_factor").join(
        ratios, "activity_type", "left"
    )
    share = F.col("ratio") * F.col("expense_factor")
    return rows.withColumn(
        "expected_tax", F.when(share.isNotNull(), net_tax(F.col("income"), share))
    )


def with_patent_tax(df: DataFrame, potential: DataFrame, district: DataFrame) -> DataFrame:
    """A twelfth of the yearly patent; independent of what was earned."""
    rows = with_workers_factor(with_district_factor(df, district)).join(
        potential, "activity_type", "left"
    )
    yearly = (
        F.col("potential_income") * F.col("district_factor") * F.col("workers_factor")
        * _dec(PATENT_RATE)
    )
    return rows.withColumn("expected_tax", F.round(yearly.cast("double") / MONTHS, 2))


def flag_anomalies(
    df: DataFrame, tolerance: float = 0.01, low: float = 0.5, high: float = 2.0
) -> DataFrame:
    """Mark rows whose tax is not what the rule gives, or whose income is out of band.

    Needs ``tax``, ``expected_tax`` and ``income_ratio``; a row no rule speaks about is not
    flagged.
    """
    wrong_tax = F.abs(F.col("tax") - F.col("expected_tax")) > F.lit(tolerance)
    return df.withColumns({
        "tax_anomaly": F.coalesce(wrong_tax, F.lit(False)),
        "high_income": F.coalesce(F.col("income_ratio") > F.lit(high), F.lit(False)),
        "low_income": F.coalesce(F.col("income_ratio") < F.lit(low), F.lit(False)),
    })


def anomaly_summary(flagged: DataFrame, by: str = "tax_type") -> DataFrame:
    return flagged.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if("tax_anomaly").alias("n_tax_anomaly"),
        F.count_if("high_income").alias("n_high_income"),
        F.count_if("low_income").alias("n_low_income"),
        (F.lit(100.0) * F.count_if(
            F.col("tax_anomaly") | F.col("high_income") | F.col("low_income")
        ) / F.count(F.lit(1))).alias("anomaly_pct"),
    )


def bands_by_year(bands: DataFrame) -> DataFrame:
    """Year ranges unfolded to one row per year; of overlapping bands the first one counts.

    Settling overlaps on the small side turns the range join into an equality join, with
    no ranking of the facts. A band that ends before it begins covers no year.
    """
    years = bands.where(F.col("year_from") <= F.col("year_to")).select(
        "band", "low", "high", F.explode(F.sequence("year_from", "year_to")).alias("yr")
    )
    chosen = F.min_by(F.struct("low", "high"), "band").alias("price")
    return years.groupBy("yr").agg(chosen).select("yr", "price.*")


def with_price_band(
    df: DataFrame, bands: DataFrame, default: int = FLAT_PRICE_DEFAULT
) -> DataFrame:
    """Low and high price of the row's year; ``default`` for years outside every band."""
    return df.join(bands_by_year(bands), "yr", "left").withColumns({
        "low": F.coalesce("low", F.lit(default)),
        "high": F.coalesce("high", F.lit(default)),
    })


def with_price_band_at(
    df: DataFrame, bands: DataFrame, point: str, low: str, high: str,
    default: int = FLAT_PRICE_DEFAULT, keys: Sequence[str] = (),
) -> DataFrame:
    """As ``with_price_band`` for bands between any two ordered values, such as dates; of overlapping
    bands the first one counts, and a missing end leaves a band open."""
    return with_interval(df, bands, point, low, high, "band", ["low", "high"], keys).withColumns({
        "low": F.coalesce("low", F.lit(default)),
        "high": F.coalesce("high", F.lit(default)),
    })


def with_land_value(df: DataFrame, bands: DataFrame, default: int) -> DataFrame:
    """Value range of ``area`` square metres at the price band of the year."""
    return with_price_band(df, bands, default).withColumns({
        "low_value": F.col("low") * F.col("area"),
        "high_value": F.col("high") * F.col("area"),
    })


def with_average_salary(
    df: DataFrame, averages: DataFrame, spread: tuple[float, float],
    default: int = AVERAGE_SALARY_DEFAULT,
) -> DataFrame:
    """Average of the year and the income range around it."""
    average = F.coalesce(F.col("average"), F.lit(default))
    return df.join(averages, "yr", "left").withColumn("average", average).withColumns({
        "income_from": F.col("average").cast("double") * spread[0],
        "income_to": F.col("average").cast("double") * spread[1],
    })


def assets_by_type(objects: DataFrame) -> DataFrame:
    """Number, total value and last acquisition of each payer's objects by kind."""
    return objects.groupBy("taxpayer_id", "object_type").agg(
        F.count(F.lit(1)).alias("n_objects"),
        F.sum("taxable_base").cast("double").alias("taxable_base"),
        F.max("acquisition_date").alias("last_acquired"),
    )


def assets_wide(objects: DataFrame, kinds: list[str]) -> DataFrame:
    """One row per payer with the total of each kind; the kinds are named by the caller."""
    return objects.groupBy("taxpayer_id").agg(*[
        F.sum(F.when(F.col("object_type") == k, F.col("taxable_base")))
        .cast("double")
        .alias(f"base_{k.lower()}")
        for k in kinds
    ])
