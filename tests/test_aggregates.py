import pytest
from pyspark.sql import functions as F

from fiscus.operators import aggregates as A
from fiscus.operators import joins as J


def by_year(df, *names):
    return {r["yr"]: tuple(r[n] for n in names) for r in df.collect()}


def test_growth_edges(make_facts):
    facts = make_facts([
        (1, 2020, 1, "A", 0, 0, 10),      # zero base
        (1, 2021, 1, "A", 50, 5, 20),
        (1, 2024, 1, "A", 75, 4, 15),     # 2022 and 2023 have no rows
        (1, 2020, 1, "B", 100, 1, 1),
        (1, 2021, 1, "B", 50, 1, 2),
    ])
    grown = A.growth(A.yearly(facts, by=["tax_type"]), by=["tax_type"])
    a = by_year(grown.where("tax_type = 'A'"), "income_growth", "transactions_growth")
    assert a == {2020: (None, None), 2021: (None, 100.0), 2024: (50.0, -25.0)}
    b = by_year(grown.where("tax_type = 'B'"), "income_growth")
    assert b == {2020: (None,), 2021: (-50.0,)}


def test_single_year_has_no_growth(make_facts):
    grown = A.growth(A.yearly(make_facts([(1, 2020, 1, "A", 1, 1, 1)]))).first()
    assert grown["income_growth"] is None


def test_total_row_counts_facts_without_a_regime(make_facts):
    facts = make_facts([(1, 2020, 1, "A", 10, 1, 1), (2, 2020, 1, None, 5, 1, 1)])
    for mode, total in (("sum", 15.0), ("median", 7.5)):
        rows = {r["tax_type"]: r["income"] for r in A.by_type_with_total(facts, mode).collect()}
        assert rows == {"A": 10.0, None: total}


def test_types_add_up_to_the_total_and_months_to_the_year(make_facts):
    facts = make_facts([
        (p, y, m, t, p * m + 0.25, 0.1 * p, m)
        for p in range(4) for y in (2020, 2021) for m in range(1, 13) for t in "AB"
    ])
    rows = A.by_type_with_total(facts).collect()
    for year in (2020, 2021):
        parts = [r for r in rows if r["yr"] == year]
        total = next(r for r in parts if r["tax_type"] is None)
        for m in ("income", "transactions", "tax"):
            assert sum(r[m] for r in parts if r["tax_type"]) == pytest.approx(total[m])
    months = A.monthly(facts).groupBy("yr").sum("income").collect()
    years = by_year(A.yearly(facts), "income")
    assert {r["yr"]: r["sum(income)"] for r in months} == pytest.approx({y: v for y, (v,) in years.items()})


def test_recorded_rows_win_over_predicted(make_facts):
    real = make_facts([(1, 2020, 1, "A", 10, 1, 1), (1, 2021, 1, "A", 20, 1, 1)])
    predicted = make_facts([(1, 2021, 1, "A", 99, 1, 1), (1, 2022, 1, "A", 30, 1, 1)])
    rows = A.yearly_growth(real, predicted).where("tax_type is null")
    assert by_year(rows, "income", "income_growth") == {
        2020: (10.0, None), 2021: (20.0, 100.0), 2022: (30.0, 50.0)
    }


def test_unknown_mode_and_column(make_facts):
    facts = make_facts([(1, 2020, 1, "A", 10, 1, 1)])
    with pytest.raises(ValueError):
        A.yearly(facts, "mean")
    with pytest.raises(ValueError):
        A.latest_year_total(facts, "income; drop table x")


def test_latest_year_total_is_zero_without_rows(make_facts):
    facts = make_facts([(1, 2020, 1, "A", 10, 1, 1), (1, 2021, 1, "B", 4, 1, 1)])
    assert A.latest_year_total(facts, "income", "B").first()["total"] == 4.0
    assert A.latest_year_total(facts, "income", "A").first()["total"] == 0.0
    assert A.latest_year_total(facts.limit(0), "income").first()["total"] == 0.0


def test_year_range(make_facts):
    facts = make_facts([(1, y, 1, "A", 1, 1, 1) for y in (2021, 2019, 2021)])
    row = A.year_range(facts).first()
    assert (row["min_year"], row["max_year"], row["years"]) == (2019, 2021, [2019, 2021])
    assert A.year_range(facts.limit(0)).count() == 0


def test_rows_without_a_payer_are_left_out_of_the_summary(spark):
    rows = spark.createDataFrame(
        [(1, "a", "i", 2020, 1.0, 1, 1.0), (1, "a", None, 2020, 1.0, 1, 1.0)],
        "taxpayer_id long, full_name string, inn string, yr int, income double, transactions long, tax double",
    )
    assert A.payer_year_summary(rows).count() == 1


def test_history_covers_both_sources_and_both_are_bounded(make_facts, make_payers):
    payers = make_payers([1, 2])
    real = make_facts([(1, y, 1, "A", y, 1, 1) for y in (2020, 2021)] + [(2, 2020, 1, "A", 5, 1, 1)])
    predicted = make_facts([(1, 2022, 1, "A", 9, 1, 1)]).join(payers.select("taxpayer_id", "inn"), "taxpayer_id")
    whole = J.payer_history(real, predicted, payers)
    assert sorted((r["inn"], r["yr"]) for r in whole.collect()) == [
        ("100001", 2020), ("100001", 2021), ("100001", 2022), ("100002", 2020)
    ]
    assert J.payer_history(real, predicted, payers, "100002").count() == 1
    assert J.payer_history(real, predicted, payers, "nobody").count() == 0
    late = J.payer_history(real, predicted, payers, "100001", 2021, 2021)
    assert [r["yr"] for r in late.collect()] == [2021]


def test_payers_by_tax_type(make_facts, make_payers):
    facts = make_facts([(1, 2020, m, t, 1, 1, 1) for m in (1, 2) for t in "AB"] + [(3, 2020, 1, "A", 1, 1, 1)])
    found = J.payers_by_tax_type(facts, make_payers([1, 2, 3]))
    assert sorted((r["taxpayer_id"], r["tax_type"]) for r in found.collect()) == [(1, "A"), (1, "B"), (3, "A")]
    assert J.payers_by_tax_type(facts, make_payers([1, 2, 3]), "B").count() == 1


def test_grid(make_facts, make_payers):
    facts = make_facts([(1, 2020, 1, t, 1, 1, 1) for t in "AB"])
    grid = J.forecast_grid(J.payers_by_tax_type(facts, make_payers([1])), 2021)
    assert grid.count() == 24
    assert {(r["mon"], r["season"]) for r in grid.collect() if r["mon"] in (2, 12, 7, 9)} == {
        (2, "winter"), (12, "winter"), (7, "summer"), (9, "autumn")
    }
    assert J.forecast_grid(make_payers([1]).limit(0), 2021).count() == 0


def test_the_grid_is_spread_before_it_is_scored(make_payers):
    grid = J.forecast_grid(make_payers(range(300)).coalesce(1), 2021)
    sizes = grid.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 8 and max(r["count"] for r in sizes) < 0.2 * 300 * 12


def test_anti_join_treats_null_as_a_key(spark):
    rows = spark.createDataFrame([(2020, None), (2020, "A"), (2021, None)], "yr int, tax_type string")
    stored = spark.createDataFrame([(2020, None), (2021, "A")], "yr int, tax_type string")
    left = J.rows_absent_from(rows, stored, ["yr", "tax_type"]).collect()
    assert sorted((r["yr"], r["tax_type"] or "-") for r in left) == [(2020, "A"), (2021, "-")]


def test_months_without_economy_stay(make_facts, spark):
    econ = spark.createDataFrame([(2020, 1, 3.5, None)], "yr int, mon int, core_cpi double, retail_sales double")
    facts = make_facts([(1, 2020, 1, "A", 1, 1, 1), (1, 2020, 2, "A", 1, 1, 1)])
    rows = {r["mon"]: (r["core_cpi"], r["retail_sales"]) for r in J.with_months(facts, econ).collect()}
    assert rows == {1: (3.5, None), 2: (None, None)}
