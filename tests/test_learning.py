import math
import random

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from fiscus.functions.lookups import ECON_SCENARIO
from fiscus.operators import features as X
from fiscus.operators import forecast as C
from fiscus.operators import metrics as R
from fiscus.operators import models as M


@pytest.fixture(scope="module")
def facts(make_facts):
    rng = random.Random(3)
    return make_facts([
        (p, y, m, "AB"[p % 2], 1000 + 100 * m + 50 * (p % 2) + rng.randint(0, 20), 60 + 6 * m, 3 + m)
        for p in range(30) for y in (2020, 2021) for m in range(1, 13)
    ])


@pytest.fixture(scope="module")
def payers(make_payers):
    return make_payers(
        range(31), activity_type=lambda i: ["IT", "FOOD"][i % 2], has_employees=lambda i: i % 3 == 0,
        employees_count=lambda i: i if i % 3 == 0 else None,
    )


@pytest.fixture(scope="module")
def econ(spark):
    rows = [(y, m, 100.0 + m, None if m == 6 else float(y - 2000)) for y in (2020, 2021) for m in range(1, 13)]
    return spark.createDataFrame(rows, "yr int, mon int, core_cpi double, cpi_yoy double")


@pytest.fixture(scope="module")
def train(facts, payers, econ):
    return M.training_input(facts, payers, econ)


@pytest.fixture(scope="module")
def model(train):
    return M.fit_forecast(train, trees=3)


def metrics_of(spark, pairs):
    df = spark.createDataFrame(pairs, "y_test double, y_pred double")
    return R.regression_metrics(df).first().asDict()


def test_metrics(spark):
    got = metrics_of(spark, [(1.0, 2.0), (2.0, 2.0), (4.0, 1.0), (0.0, 1.0)])
    assert got["mae"] == 1.25 and got["mse"] == 2.75 and got["median_ae"] == 1.0
    assert got["max_error"] == 3.0 and got["observations"] == 4
    assert got["rmse"] == pytest.approx(math.sqrt(2.75))
    assert got["mape"] == pytest.approx((1 + 0 + 0.75) / 3 * 100)
    y = np.array([1.0, 2.0, 4.0, 0.0])
    assert got["r2"] == pytest.approx(1 - 11 / ((y - y.mean()) ** 2).sum())


def test_metrics_edges(spark):
    assert metrics_of(spark, [(0.0, 1.0), (0.0, 2.0)])["mape"] is None
    assert metrics_of(spark, [(3.0, 1.0), (3.0, 2.0)])["r2"] == 0.0
    assert metrics_of(spark, [(3.0, 3.0), (3.0, 3.0)])["r2"] == 1.0
    one = metrics_of(spark, [(3.0, 2.0)])
    assert one["observations"] == 1 and one["median_ae"] == 1.0


def test_metrics_by_group_with_a_null_group(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), (None, 1.0, 4.0)], "g string, y_test double, y_pred double")
    rows = {r["g"]: r["median_ae"] for r in R.regression_metrics(df, by=["g"]).collect()}
    assert rows == {"a": 1.0, None: 3.0}


def test_split_is_stable_and_complete(train):
    left, right = X.split_train_test(train)
    other, _ = X.split_train_test(train.repartition(13))
    key = list(X.FACT_KEY)
    assert left.count() + right.count() == train.count()
    assert 0.7 < left.count() / train.count() < 0.9
    assert left.select(key).exceptAll(other.select(key)).count() == 0


def test_most_frequent_settles_ties(spark):
    df = spark.createDataFrame([("b", None), ("a", "x"), ("a", None), ("b", None)], "p string, q string")
    rows = {r["feature"]: (r["value"], r["n"]) for r in X.most_frequent(df, ["p", "q"]).collect()}
    assert rows == {"p": ("a", 2), "q": ("x", 1)}


def test_fills_skip_columns_without_values(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, None), (None, None)], "a double, b double")
    assert X.median_fills(df, ["a", "b"]) == {"a": 2.0}
    assert X.known_columns(df, ["a", "b"]) == ["a"]


def test_standardize_uses_the_population_deviation(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, flat double")
    rows = sorted(tuple(r) for r in X.standardize(df, ["a", "flat"]).collect())
    assert rows == [(-1.0, 0.0), (1.0, 0.0)]


def test_unseen_and_null_categories(spark):
    train = spark.createDataFrame([("a's",), ("b",), ("b",)], "c string")
    rows = spark.createDataFrame([("a's",), ("b",), ("new",), (None,)], "c string")
    fitted = Pipeline(stages=X.feature_stages(train, ["c"], [])).fit(train)
    found = {r["c"]: list(r[X.FEATURES].toArray()) for r in fitted.transform(rows).collect()}
    # A null takes the most frequent category; a new one is all zeros.
    assert found == {"a's": [1, 0], "b": [0, 1], "new": [0, 0], None: [0, 1]}
    assert X.feature_names(fitted, ["c"], []) == ["c_a's", "c_b"]


def test_year_as_a_category_and_numbered_categories(train):
    flags = Pipeline(stages=X.feature_stages(train, ["yr", "tax_type"], ["mon"])).fit(train)
    future = train.where("yr = 2021").withColumn("yr", F.lit(2030))
    found = {tuple(r[X.FEATURES].toArray()[1:3]) for r in flags.transform(future).collect()}
    assert found == {(0.0, 0.0)}  # a year that was not seen
    numbered = Pipeline(stages=X.feature_stages(train, ["tax_type"], ["mon"], flags=False)).fit(train)
    assert {r[X.FEATURES][1] for r in numbered.transform(train).collect()} == {0.0, 1.0}


def test_ridge_is_the_closed_form(train):
    alpha = 7.0
    fitted = M.fit_ridge(train, alpha)
    rows = fitted.transform(train).select(X.FEATURES, "transactions").collect()
    x = np.array([r[0].toArray() for r in rows])
    y = np.array([r[1] for r in rows])
    xc, yc = x - x.mean(0), y - y.mean()
    beta = np.linalg.solve(xc.T @ xc + alpha * np.eye(x.shape[1]), xc.T @ yc)
    assert np.allclose(fitted.stages[-1].coefficients.toArray(), beta, atol=1e-5)


def test_indicators_never_known_are_left_out(train):
    assert "retail_sales" not in M.ridge_inputs(train)
    assert "core_cpi" in M.ridge_inputs(train)


def test_ridge_search(train):
    found = M.search_ridge(train, alphas=(0.1, 10.0, 100000.0), folds=3).collect()
    assert [r["alpha"] for r in found] == [0.1, 10.0, 100000.0]
    best = next(r for r in found if r["best"])
    assert best["mean_r2"] == max(r["mean_r2"] for r in found)
    assert best["alpha"] != 100000.0


def test_ridge_search_equals_a_pipeline_for_each_fold(train, spark):
    # Nulls in a category and in numbers, so that what fills them differs from fold to fold.
    holes = train.withColumns({
        "activity_type": F.when(F.crc32(F.concat_ws("|", *X.FACT_KEY)) % 3 != 0, F.col("activity_type")),
        "income": F.when(F.crc32(F.concat_ws("|", "mon", *X.FACT_KEY)) % 4 != 0, F.col("income")),
    })
    alphas, folds = (0.5, 20.0), 3
    found = {r["alpha"]: r["mean_r2"] for r in M.search_ridge(holes, alphas, folds).collect()}
    numbers = M.ridge_inputs(holes)
    rows, scores = X.with_fold(holes, folds), {a: [] for a in alphas}
    for k in range(folds):
        fitted_on, held_out = rows.where(F.col("fold") != k).persist(), rows.where(F.col("fold") == k)
        stages = Pipeline(stages=X.feature_stages(fitted_on, numeric=numbers, scaled=True)).fit(fitted_on)
        (xa, ya), (xb, yb) = (
            (np.array([r[0].toArray() for r in got]), np.array([r[1] for r in got]))
            for got in (stages.transform(part).select(X.FEATURES, "transactions").collect() for part in (fitted_on, held_out))
        )
        for alpha in alphas:
            xc, yc = xa - xa.mean(0), ya - ya.mean()
            beta = np.linalg.solve(xc.T @ xc + alpha * np.eye(xa.shape[1]), xc.T @ yc)
            guess = (xb - xa.mean(0)) @ beta + ya.mean()
            scores[alpha].append(1 - ((yb - guess) ** 2).sum() / ((yb - yb.mean()) ** 2).sum())
        fitted_on.unpersist()
    for alpha in alphas:
        assert found[alpha] == pytest.approx(np.mean(scores[alpha]), abs=1e-8)


def test_three_targets_from_one_matrix(train, folder):
    model = M.fit_forecast_lines(train, 2.0)
    model.write().save(folder("lines"))
    again = M.load_model(folder("lines"))
    rows = again.transform(train).select(X.FEATURES, "income", "transactions", "tax", *C.PREDICTED).toPandas()
    x = np.stack([v.toArray() for v in rows[X.FEATURES]])
    xc = x - x.mean(0)
    for m in ("income", "transactions", "tax"):
        y = rows[m].to_numpy()
        beta = np.linalg.solve(xc.T @ xc + 2.0 * np.eye(x.shape[1]), xc.T @ (y - y.mean()))
        assert np.allclose(rows[f"predicted_{m}"], xc @ beta + y.mean(), rtol=1e-7)


def test_forecasts_differ_between_payers(train, facts, payers):
    from fiscus.operators.joins import payers_by_tax_type

    grid = C.score_grid(M.fit_forecast_lines(train), payers_by_tax_type(facts, payers), 2022)
    assert grid.where("mon = 3").select("predicted_income").distinct().count() > 1


def test_grouped_rows_give_the_same_trees(spark, train):
    twice = train.unionByName(train.withColumn("income", F.col("income") + 10.0))
    prepared = Pipeline(stages=X.feature_stages(twice, flags=False)).fit(twice)
    plain = prepared.transform(twice)
    groups = prepared.transform(M.grouped(twice, (*X.CATEGORICAL, *X.NUMERIC), ["income"])).coalesce(1)
    assert groups.agg(F.sum(M.WEIGHT)).first()[0] == twice.count() and groups.count() < twice.count()
    bins = M.bins_for(twice)
    a = M.boosted_trees("income", 6, max_bins=bins).fit(plain)
    b = M.boosted_trees("income", 6, max_bins=bins).setWeightCol(M.WEIGHT).fit(groups)
    both = b.transform(a.transform(plain).withColumnRenamed("predicted_income", "p")).where("abs(predicted_income - p) > 1e-6 * abs(p)")
    assert both.count() == 0
    errors = b.evaluateEachIteration(plain.withColumn(M.WEIGHT, F.lit(1.0)), "squared")
    assert all(x >= y for x, y in zip(errors, errors[1:]))


def test_coefficients_are_ranked_by_size(spark):
    table = spark.createDataFrame([("a", 1.0), ("b", -3.0), ("c", 2.0)], "feature string, coefficient double")
    assert [r["feature"] for r in M.strongest_first(table, ["a", "b", "c"]).collect()] == ["b", "c", "a"]
    assert M.strongest_first(table, ["a"]).count() == 1


def test_saved_model_scores_the_same(model, train, folder):
    M.save_model(model, folder("model"))
    again = M.load_model(folder("model"))
    key = ["taxpayer_id", "yr", "mon", "predicted_income", "predicted_tax"]
    first, second = model.transform(train).select(key), again.transform(train).select(key)
    assert first.exceptAll(second).count() == 0


def test_forecast(model, facts, payers):
    from fiscus.operators.joins import payers_by_tax_type

    grid = C.score_grid(model, payers_by_tax_type(facts, payers), 2022)
    assert grid.count() == 30 * 12  # payer 30 has no facts
    assert grid.where("predicted_income < 0 or predicted_income is null").count() == 0
    yearly = C.yearly_forecast(grid)
    assert yearly.count() == 30
    total = grid.agg(F.sum("predicted_transactions")).first()[0]
    assert yearly.agg(F.sum("total_predicted_transactions")).first()[0] == total


def test_tidy(spark):
    df = spark.createDataFrame(
        [(-5.0, 2.5, 0.125), (1.25, 3.5, -0.1)],
        "predicted_income double, predicted_transactions double, predicted_tax double",
    )
    assert sorted(tuple(r) for r in C.tidy(df).collect()) == [(0.0, 2, 0.12), (1.25, 4, 0.0)]


def test_each_payer_is_scored_after_its_own_last_year(model, make_facts, make_payers):
    facts = make_facts([(1, 2020, 1, "A", 1, 1, 1), (2, 2021, 1, "A", 1, 1, 1), (2, 2019, 1, "B", 1, 1, 1)])
    rows = C.score_payers(model, facts, make_payers([1, 2, 3]))
    found = {(r["taxpayer_id"], r["tax_type"], r["yr"]) for r in rows.collect()}
    assert found == {(1, "A", 2021), (2, "A", 2022), (2, "B", 2022)}
    assert C.score_payers(model, facts, make_payers([1, 2, 3]), "100002").count() == 24
    assert C.score_payers(model, facts, make_payers([1, 2, 3]), "100003").count() == 0


def test_refresh(model, facts, payers, folder, spark):
    path = folder("predict")
    stored = C.refresh_forecast(model, facts, payers, path)
    assert stored.count() == 30 * 12
    files = set(stored.inputFiles())
    assert set(C.refresh_forecast(model, facts, payers, path).inputFiles()) == files
    later = facts.withColumn("yr", F.col("yr") + 1)
    again = C.refresh_forecast(model, later, payers, path)
    assert {r["yr"] for r in again.select("yr").distinct().collect()} == {2022, 2023}


def test_freshness_without_predictions_or_facts(facts):
    none = facts.limit(0)
    assert C.freshness(facts, none).first()["stale"] is True
    assert C.freshness(none, none).first()["stale"] is False
    assert C.next_year(facts) == 2022 and C.next_year(none) is None


def test_chained_models(train, facts, payers):
    from fiscus.operators.joins import payers_by_tax_type

    base = [*X.NUMERIC, *M.ECON]
    income = M.fit_log_target(train, "income", base)
    transactions = M.fit_log_target(train, "transactions", [*base, "income"], trees=2)
    tax = M.fit_tax(train, [*base, "income", "transactions"])
    rows = C.score_chained(income, transactions, tax, payers_by_tax_type(facts, payers), 2022, ECON_SCENARIO)
    assert rows.count() == 360
    assert rows.where("predicted_income is null or predicted_tax is null").count() == 0


def test_log_target_is_cut_first(spark):
    df = spark.createDataFrame([(0.0,), (1e9,)], "income double")
    found = sorted(r[0] for r in df.select(M.log_target(F.col("income"), "income")).collect())
    assert found == [pytest.approx(math.log1p(5000)), pytest.approx(math.log1p(500000))]


def test_sums_of_products_without_vectors(spark, monkeypatch):
    from fiscus.operators import products

    kept, own = [], products.materialize
    monkeypatch.setattr(products, "materialize", lambda df, *named: kept.append(df.dtypes) or own(df, *named))
    rows = [(i, 1999 + i % 3, i % 12, "abc"[i % 3], i % 7 / 2, None if i % 5 == 0 else i % 11 * 1.5, None if i % 4 == 0 else "xy"[i % 2], i * 0.25) for i in range(300)]
    df = spark.createDataFrame(rows, "taxpayer_id long, yr int, mon int, tax_type string, u double, v double, c string, label double")
    found = products.learn(df, ["label"], ["u", "v"], ["tax_type", "c"], 3)
    # What is stored is plain columns, no vector a row.
    assert len(kept) == 1 and {kind for _, kind in kept[0]} <= {"double", "string", "int"}

    def number(x, name):
        shift, unit = found.units[name]
        return 0.0 if x is None else (x - shift) / unit

    matrix = np.array([[
        number(u, "u"), number(v, "v"), 0.0, float(v is None), *[float(t == k) for k in "abc"], 0.0,
        *[float(c == k) for k in "xy"], float(c is None), label, 1.0,
    ] for *_, t, u, v, c, label in rows])
    assert len(found.folds) == 3 and all(f[-1, -1] > 0 for f in found.folds)
    np.testing.assert_allclose(found.outside(), matrix.T @ matrix, rtol=1e-9, atol=1e-9)
