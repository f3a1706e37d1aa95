from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from fiscus.functions import lookups as K
from fiscus.functions import scalars as S
from fiscus.operators import rules as G


def test_workers(spark):
    counts = [None, 0, 1, 2, 3, 5, 6, 10, 11, 500]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(counts)], "i int, employees_count int")
    found = [float(r["workers_factor"]) for r in G.with_workers_factor(df).orderBy("i").collect()]
    assert found == [0.9, 0.9, 1.0, 1.0, 1.15, 1.15, 1.3, 1.3, 1.5, 1.5]


def test_price_bands(spark):
    df = spark.createDataFrame([(y,) for y in (1999, 2000, 2013, 2014, 2015, 2024, 2025)], "yr int")
    rows = {r["yr"]: (r["low"], r["high"]) for r in G.with_price_band(df, K.flat_price_bands(spark)).collect()}
    assert rows == {
        1999: (60000, 60000), 2000: (10000, 30000), 2013: (50000, 55000),
        2014: (50000, 55000),  # in two bands: the first one counts
        2015: (55000, 60000), 2024: (150000, 200000), 2025: (60000, 60000),
    }


def test_land_values(spark):
    df = spark.createDataFrame([(1995, 10), (1990, 10), (2025, 2)], "yr int, area int")
    land = G.with_land_value(df, K.land_price_bands(spark), K.LAND_PRICE_DEFAULT)
    rows = {r["yr"]: (r["low_value"], r["high_value"]) for r in land.collect()}
    assert rows == {1995: (5000, 30000), 1990: (100000, 100000), 2025: (100000, 400000)}


def test_average_salary(spark):
    df = spark.createDataFrame([(2020,), (2019,)], "yr int")
    rows = G.with_average_salary(df, K.average_salary(spark), K.SALARY_SPREAD)
    found = {r["yr"]: (r["average"], r["income_from"]) for r in rows.collect()}
    assert found == {2020: (51220, pytest.approx(40976.0)), 2019: (60000, 48000.0)}


MONTH = (
    "activity_type string, registration_district string, season string, yr int, tax_type string, "
    "income decimal(18,2), tax decimal(18,2), employees_count int"
)


def test_expected_income_and_taxes(spark):
    df = spark.createDataFrame(
        [
            ("IT", "Центральный", "summer", 2024, "NPD", Decimal("63700.00"), Decimal("3822.00"), None),
            ("IT", "elsewhere", "winter", 2025, "IPOS", Decimal("0.00"), Decimal("0.00"), 4),
        ],
        MONTH,
    )
    rows = G.with_expected_income(
        df, K.base_income(spark, "SZ"), K.seasonal_income(spark), K.district_factor(spark), use_workers=False
    )
    found = {r["season"]: (r["expected_income"], r["income_ratio"]) for r in rows.collect()}
    assert found["summer"] == (pytest.approx(65000 * 0.7 * 1.4), pytest.approx(1.0))
    assert found["winter"] == (70000.0, 0.0)

    taxed = {r["tax_type"]: r["expected_tax"] for r in G.with_flat_tax(df, K.flat_rate(spark)).collect()}
    assert taxed == {"NPD": Decimal("3822.00"), "IPOS": Decimal("0.00")}

    patent = G.with_patent_tax(df, K.potential_income(spark), K.district_factor(spark))
    found = {r["season"]: r["expected_tax"] for r in patent.collect()}
    assert found == {
        "summer": round(1500000 * 1.4 * 0.9 * 0.06 / 12, 2), "winter": round(1500000 * 1.15 * 0.06 / 12, 2)
    }

    marked = G.flag_anomalies(G.with_flat_tax(rows, K.flat_rate(spark)))
    flags = {r["season"]: (r["tax_anomaly"], r["high_income"], r["low_income"]) for r in marked.collect()}
    assert flags == {"summer": (False, False, False), "winter": (False, False, True)}


def test_expenses_are_capped(spark):
    df = spark.createDataFrame(
        [("FOOD", "x", "winter", 2024, "IP15", Decimal("1000.00"), Decimal("0.00"), 0),
         ("IT", "x", "winter", 2024, "IP15", Decimal("1000.00"), Decimal("0.00"), 0),
         ("OTHER", "x", "winter", 2024, "IP15", Decimal("1000.00"), Decimal("0.00"), 0)],
        MONTH,
    )
    rows = G.with_net_tax(df, K.expense_ratio(spark), K.seasonal_expense(spark))
    found = {r["activity_type"]: r["expected_tax"] for r in rows.collect()}
    # 0.85 * 1.2 is cut to 0.75; 0.40 * 1.0 is not.
    assert found == {"FOOD": Decimal("37.50"), "IT": Decimal("90.00"), "OTHER": None}


def test_fixed_tables_are_complete():
    activities = set(K.SEASONAL_INCOME)
    assert len(activities) == 8
    for other in (K.SEASONAL_EXPENSE, K.POTENTIAL_INCOME, K.EXPENSE_RATIO, *K.BASE_INCOME.values()):
        assert set(other) == activities
    assert len(K.DISTRICT_FACTOR) == 18
    assert len(K.seasonal_rows(K.SEASONAL_INCOME)) == 32
    assert set(K.BASE_INCOME) == {"SZ", "IP15", "IPP", "IPOS"}


def test_rule_tables_have_a_known_size(spark):
    # Literal relations: the planner broadcasts them because it knows they are small.
    facts = spark.range(10).select(
        F.col("id").cast("string").alias("activity_type"), F.col("id").cast("string").alias("season")
    )
    plan = G.with_seasonal_factor(facts, K.seasonal_income(spark))._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan


def test_seasons_of_both_vocabularies(spark):
    labels = ["Зима", "Весна", "Лето", "Осень", "winter", "other", None]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(labels)], "i int, s string")
    found = [r[0] for r in df.orderBy("i").select(S.season_normalize(F.col("s"))).collect()]
    assert found == ["winter", "spring", "summer", "autumn", "winter", "other", None]


def test_clipping_and_rounding_keep_nulls(spark):
    df = spark.createDataFrame([(1, -1.0), (2, None), (3, 2.5), (4, 3.5)], "i int, x double")
    x = F.col("x")
    rows = df.orderBy("i").select(S.clip_low(x), S.clip_range(x, 0, 3), S.round_half_even(x, 0)).collect()
    assert [tuple(r) for r in rows] == [(0.0, 0.0, -1.0), (None, None, None), (2.5, 2.5, 2.0), (3.5, 3.0, 4.0)]


def test_assets(spark):
    objects = spark.createDataFrame(
        [(1, "property", 10.0), (1, "property", 5.0), (1, "income", 2.0), (2, "income", 1.0)],
        "taxpayer_id long, object_type string, taxable_base double",
    ).withColumn("acquisition_date", F.lit(None).cast("date"))
    rows = {(r[0], r[1]): (r[2], r[3]) for r in G.assets_by_type(objects).collect()}
    assert rows[(1, "property")] == (2, 15.0)
    wide = {r["taxpayer_id"]: (r["base_property"], r["base_income"]) for r in G.assets_wide(objects, ["property", "income"]).collect()}
    assert wide == {1: (15.0, 2.0), 2: (None, 1.0)}
