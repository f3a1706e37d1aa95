"""Fixed values of the tax rules, and how they become small tables.

Every table here is a constant of the program. ``values_table`` turns one into a literal
relation whose exact size Spark knows, so its own broadcast threshold decides the join.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

# --------------------------------------------------------------------------------------
# Fixed values
# --------------------------------------------------------------------------------------

# Seasonal weight of income by activity: winter, spring, summer, autumn.
SEASONAL_INCOME = {
    "TRADE": (1.2, 1.0, 0.9, 1.1),
    "SERVICES": (1.1, 1.0, 0.8, 1.2),
    "IT": (1.0, 1.0, 0.7, 1.1),
    "FREELANCE": (1.0, 1.1, 0.6, 1.2),
    "PRODUCTION": (0.9, 1.1, 1.0, 1.0),
    "FOOD": (1.1, 1.0, 1.3, 0.9),
    "LOGISTICS": (1.3, 1.0, 0.8, 1.2),
    "EDUCATION": (1.0, 0.8, 0.4, 1.5),
}

# Seasonal weight of expenses by activity: winter, spring, summer, autumn.
SEASONAL_EXPENSE = {
    "TRADE": (1.1, 1.0, 0.9, 1.0),
    "SERVICES": (1.0, 1.1, 0.8, 1.1),
    "IT": (1.0, 1.0, 0.8, 1.0),
    "FREELANCE": (1.0, 1.0, 0.7, 1.1),
    "PRODUCTION": (0.9, 1.2, 1.0, 1.0),
    "FOOD": (1.2, 1.0, 1.2, 0.9),
    "LOGISTICS": (1.2, 1.0, 0.9, 1.1),
    "EDUCATION": (1.0, 0.9, 0.5, 1.3),
}

# Monthly base income by payer type and activity: 2023, 2024, 2025.
BASE_INCOME = {
    "SZ": {
        "TRADE": (48000, 52000, 56000),
        "SERVICES": (45000, 50000, 54000),
        "IT": (60000, 65000, 70000),
        "FREELANCE": (50000, 55000, 60000),
        "PRODUCTION": (47000, 51000, 55000),
        "FOOD": (52000, 56000, 60000),
        "LOGISTICS": (55000, 60000, 65000),
        "EDUCATION": (46000, 50000, 54000),
    },
    "IP15": {
        "TRADE": (115000, 117000, 120000),
        "SERVICES": (110000, 112000, 115000),
        "IT": (120000, 120000, 120000),
        "FREELANCE": (110000, 112000, 115000),
        "PRODUCTION": (115000, 117000, 120000),
        "FOOD": (110000, 113000, 115000),
        "LOGISTICS": (112000, 115000, 118000),
        "EDUCATION": (110000, 112000, 115000),
    },
    "IPP": {
        "TRADE": (90000, 95000, 100000),
        "SERVICES": (85000, 90000, 95000),
        "IT": (100000, 110000, 120000),
        "FREELANCE": (90000, 95000, 100000),
        "PRODUCTION": (88000, 93000, 98000),
        "FOOD": (92000, 97000, 102000),
        "LOGISTICS": (95000, 100000, 105000),
        "EDUCATION": (90000, 95000, 100000),
    },
    "IPOS": {
        "TRADE": (500000, 550000, 600000),
        "SERVICES": (400000, 450000, 500000),
        "IT": (600000, 700000, 800000),
        "FREELANCE": (300000, 350000, 400000),
        "PRODUCTION": (450000, 500000, 550000),
        "FOOD": (350000, 400000, 450000),
        "LOGISTICS": (400000, 450000, 500000),
        "EDUCATION": (300000, 350000, 400000),
    },
}
BASE_INCOME_YEARS = (2023, 2024, 2025)

# Yearly potential income by activity, for payers on a patent.
POTENTIAL_INCOME = {
    "TRADE": 1200000,
    "SERVICES": 1000000,
    "IT": 1500000,
    "FREELANCE": 1100000,
    "PRODUCTION": 1300000,
    "FOOD": 1400000,
    "LOGISTICS": 1250000,
    "EDUCATION": 1000000,
}

# Share of income spent, by activity.
EXPENSE_RATIO = {
    "TRADE": 0.75,
    "SERVICES": 0.65,
    "IT": 0.40,
    "FREELANCE": 0.30,
    "PRODUCTION": 0.80,
    "FOOD": 0.85,
    "LOGISTICS": 0.70,
    "EDUCATION": 0.60,
}

# Price level of the registration district; other districts count as 1.0.
DISTRICT_FACTOR = {
    "Приморский": 1.3,
    "Центральный": 1.4,
    "Петроградский": 1.3,
    "Василеостровский": 1.2,
    "Адмиралтейский": 1.1,
    "Фрунзенский": 1.0,
    "Московский": 1.0,
    "Невский": 1.0,
    "Красногвардейский": 0.9,
    "Кировский": 0.9,
    "Калининский": 0.9,
    "Выборгский": 0.9,
    "Красносельский": 0.9,
    "Петродворцовый": 1.1,
    "Курортный": 1.2,
    "Пушкинский": 1.0,
    "Колпинский": 0.8,
    "Кронштадтский": 0.8,
}

# Flat tax rates by regime.
FLAT_RATE = {"NPD": 0.06, "IPOS": 0.20}
NET_INCOME_RATE = 0.15
PATENT_RATE = 0.06
MAX_EXPENSE_SHARE = 0.75

# Price of a flat per square metre: first year, last year, low, high. 2014 is in two bands.
FLAT_PRICE_BANDS = (
    (2000, 2004, 10000, 30000),
    (2005, 2008, 55000, 60000),
    (2009, 2009, 45000, 50000),
    (2010, 2014, 50000, 55000),
    (2014, 2015, 55000, 60000),
    (2016, 2019, 55000, 70000),
    (2020, 2020, 65000, 70000),
    (2021, 2021, 70000, 80000),
    (2022, 2022, 110000, 120000),
    (2023, 2023, 130000, 140000),
    (2024, 2024, 150000, 200000),
)
FLAT_PRICE_DEFAULT = 60000

# Price of land per square metre: first year, last year, low, high.
LAND_PRICE_BANDS = (
    (1991, 1999, 500, 3000),
    (2000, 2009, 3000, 15000),
    (2010, 2019, 15000, 50000),
    (2020, 2025, 50000, 200000),
)
LAND_PRICE_DEFAULT = 10000

# Average monthly salary by year; other years count as 60000.
AVERAGE_SALARY = {
    2020: 51220,
    2021: 56990,
    2022: 66390,
    2023: 73709,
    2024: 84500,
    2025: 91500,
}
AVERAGE_SALARY_DEFAULT = 60000
SALARY_SPREAD = (0.8, 1.2)
BUSINESS_SPREAD = (1.5, 3.0)

# One future economic scenario, attached to every month of a forecast.
ECON_SCENARIO = {
    "core_cpi": 118.0,
    "cpi_yoy": 6.5,
    "reer": 101.5,
    "retail_sales": 110.2,
    "unemployment": 4.9,
}

SEASONS = ("winter", "spring", "summer", "autumn")


# --------------------------------------------------------------------------------------
# Tables
# --------------------------------------------------------------------------------------

def _literal(value) -> str:
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return "null" if value is None else repr(value)


def values_sql(columns: str, rows: Iterable[tuple]) -> str:
    """``select * from (values …) t(columns)``, understood by any SQL engine."""
    body = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    return f"select * from (values {body}) t({columns})"


def values_table(spark: SparkSession, columns: str, rows: Iterable[tuple]) -> DataFrame:
    return spark.sql(values_sql(columns, rows))


def seasonal_rows(weights: dict[str, tuple]) -> list[tuple]:
    return [
        (activity, name, weight)
        for activity, by_season in weights.items()
        for name, weight in zip(SEASONS, by_season)
    ]


def base_income_rows(payer_type: str) -> list[tuple]:
    return [
        (activity, year, amount)
        for activity, amounts in BASE_INCOME[payer_type].items()
        for year, amount in zip(BASE_INCOME_YEARS, amounts)
    ]


def seasonal_income(spark: SparkSession) -> DataFrame:
    return values_table(spark, "activity_type, season, factor", seasonal_rows(SEASONAL_INCOME))


def seasonal_expense(spark: SparkSession) -> DataFrame:
    return values_table(spark, "activity_type, season, factor", seasonal_rows(SEASONAL_EXPENSE))


def base_income(spark: SparkSession, payer_type: str) -> DataFrame:
    return values_table(spark, "activity_type, yr, base_income", base_income_rows(payer_type))


def district_factor(spark: SparkSession) -> DataFrame:
    return values_table(spark, "registration_district, factor", DISTRICT_FACTOR.items())


def expense_ratio(spark: SparkSession) -> DataFrame:
    return values_table(spark, "activity_type, ratio", EXPENSE_RATIO.items())


def potential_income(spark: SparkSession) -> DataFrame:
    return values_table(spark, "activity_type, potential_income", POTENTIAL_INCOME.items())


def flat_rate(spark: SparkSession) -> DataFrame:
    return values_table(spark, "tax_type, rate", FLAT_RATE.items())


def flat_price_bands(spark: SparkSession) -> DataFrame:
    rows = [(n, *band) for n, band in enumerate(FLAT_PRICE_BANDS)]
    return values_table(spark, "band, year_from, year_to, low, high", rows)


def land_price_bands(spark: SparkSession) -> DataFrame:
    rows = [(n, *band) for n, band in enumerate(LAND_PRICE_BANDS)]
    return values_table(spark, "band, year_from, year_to, low, high", rows)


def average_salary(spark: SparkSession) -> DataFrame:
    return values_table(spark, "yr, average", AVERAGE_SALARY.items())
