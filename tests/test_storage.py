import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from fiscus.operators import metrics as R
from fiscus.schemas import PREDICT, YEARLY_GROWTH
from fiscus.session import CHECKPOINT_KEY, materialize, shared_folder
from fiscus.sources import csv_files, marts, tables


@pytest.fixture
def real(make_facts):
    return make_facts([
        (1, y, m, t, 10 * m + y - 2020, 1, 1) for y in (2020, 2021) for m in (1, 2) for t in "AB"
    ])


@pytest.fixture
def predicted(make_facts):
    return make_facts([(1, 2022, 1, t, 5, 1, 1) for t in "AB"])


def test_rows_already_stored_are_kept_and_a_second_run_adds_nothing(real, predicted, folder):
    path = folder("growth")
    rows = marts.yearly_growth_rows(real, predicted, "sum")
    marts.merge_absent(
        rows.where("tax_type is null and yr = 2020").withColumn("income_total", F.lit(-1.0)),
        path, YEARLY_GROWTH, marts.GROWTH_KEYS,
    )
    once = marts.merge_absent(rows, path, YEARLY_GROWTH, marts.GROWTH_KEYS)
    assert once.count() == 9
    assert once.where("income_total = -1").count() == 1
    assert marts.merge_absent(rows, path, YEARLY_GROWTH, marts.GROWTH_KEYS).count() == 9
    assert marts.refresh(rows, path, YEARLY_GROWTH).where("income_total = -1").count() == 0


def test_undefined_growth_is_stored_as_zero(real, predicted):
    rows = marts.yearly_growth_rows(real, predicted, "median")
    assert rows.where("yr = 2020 and income_growth = 0").count() == 3
    assert rows.where("income_growth is null").count() == 0


def test_lazy_summary_fills_once(real, predicted, folder, spark):
    path, calls = folder("lazy"), []

    def rows():
        calls.append(1)
        return marts.yearly_growth_rows(real, predicted, "sum")

    def ask(tax_type=None, start=None, end=None):
        return marts.summary_or_fill(
            spark, path, YEARLY_GROWTH, marts.GROWTH_KEYS, rows, tax_type, start, end
        )

    assert [r["yr"] for r in ask("A", 2021).collect()] == [2021, 2022]
    assert [r["tax_type"] for r in ask(None, 2020, 2020).collect()] == [None]
    assert ask("B").count() == 3
    assert len(calls) == 1
    assert ask("no such regime").count() == 0


def test_monthly_medians_pool_both_sources(make_facts, folder):
    real = make_facts([(1, 2020, 1, "A", 10, 1, 1)])
    predicted = make_facts([(2, 2020, 1, "A", 30, 1, 1), (2, 2020, 2, "A", 7, 1, 1)])
    found = marts.monthly_median_summary(real, predicted, folder("m"), "A")
    assert [(r["mon"], r["income"]) for r in found.collect()] == [(1, 20.0), (2, 7.0)]
    assert found.where("created_at is null").count() == 0


def test_a_forecast_replaces_only_its_own_year(spark, folder):
    def forecast(year, income):
        return spark.createDataFrame(
            [(1, year, 1, income, 2, 0.5)],
            "taxpayer_id long, yr int, mon int, predicted_income double, predicted_transactions long, predicted_tax double",
        )

    path = folder("predict")
    marts.replace_year(forecast(2021, 1.0), path)
    marts.replace_year(forecast(2022, 2.0), path)
    stored = marts.replace_year(forecast(2022, 3.0), path)
    assert sorted((r["yr"], r["income"]) for r in stored.collect()) == [(2021, 1.0), (2022, 3.0)]
    assert stored.columns == PREDICT.names
    assert stored.where("full_name is null").count() == 2


def test_open_table(spark, folder):
    assert marts.open_table(spark, folder("nothing"), PREDICT).count() == 0


def test_metrics_are_appended(spark, folder):
    df = spark.createDataFrame([(1.0, 2.0)], "y_test double, y_pred double")
    for target in ("Income", "Tax"):
        stored = marts.append_model_metrics(R.regression_metrics(df), folder("metrics"), "GBT", target)
    assert {r["target_name"] for r in stored.collect()} == {"Income", "Tax"}
    assert stored.where("dataset_type = 'test' and tax_type is null").count() == 2


def test_economic_file_with_awkward_headers(spark, tmp_path):
    path = tmp_path / "econ.csv"
    path.write_text(
        'Time,"Index,a,,, [X.1]","Rate, %,, [Y]",Third,Fourth,Fifth\n'
        "01.01.2000,..,29.5,49.1,..,11.9\n12.01.2001,3,..,50,..,..\n"
    )
    rows = [tuple(r) for r in csv_files.read_econ_csv(spark, str(path)).collect()]
    assert rows == [(2000, 1, None, 29.5, 49.1, None, 11.9), (2001, 12, 3.0, None, 50.0, None, None)]


def test_prediction_files_of_both_spellings(spark, tmp_path):
    for name in ("y_test", "y_true"):
        path = tmp_path / f"{name}.csv"
        path.write_text(f"{name},y_pred\n1.5,2\n")
        row = csv_files.read_predictions_csv(spark, str(path)).first()
        assert (row["y_test"], row["y_pred"]) == (1.5, 2.0)


def test_sql_parameters_are_bound_not_spliced(spark, make_facts):
    facts = make_facts([(1, 2020, 1, "A", 10, 1, 1)])
    query = "select * from {facts} where tax_type = :t"
    assert tables.run_sql(spark, query, {"t": "A"}, facts=facts).count() == 1
    assert tables.run_sql(spark, query, {"t": "A' or '1' = '1"}, facts=facts).count() == 0
    assert tables.run_sql(spark, "select ? + ?", [1, 2]).first()[0] == 3
    with pytest.raises(AnalysisException):
        tables.run_sql(spark, "select * from no_such_table")


def test_facts_stored_by_year_are_pruned(make_facts, folder, spark):
    from fiscus.operators.filters import in_years
    from fiscus.schemas import MONTHLY_TAX

    facts = make_facts([(1, y, 1, "A", 10, 1, 1) for y in range(2015, 2025)])
    tables.write_facts(facts, folder("facts"))
    rows = in_years(tables.read_table(spark, folder("facts"), MONTHLY_TAX), 2020, 2021)
    assert rows.count() == 2
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(yr" in plan


def test_shared_folder(spark):
    base = spark.conf.get(CHECKPOINT_KEY, None)
    first, second = shared_folder(spark, "x"), shared_folder(spark, "x")
    assert first != second
    if base:
        assert first.startswith(base)
    assert materialize(spark.range(3), "numbers").count() == 3
