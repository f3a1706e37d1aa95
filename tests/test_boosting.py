import random

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from fiscus.operators import boosting as B
from fiscus.operators import features as X
from fiscus.operators import models as M

KINDS = ("kind", "place")
NUMBERS = ("size", "mon")


@pytest.fixture(scope="module")
def rows(spark):
    """Rows with a number of 300 values, a weight, and targets in which no two splits are equally good."""
    rng = random.Random(5)
    found = []
    for i in range(2400):
        size, mon, kind, place = rng.randrange(300), i % 12 + 1, "abc"[i % 3], f"p{rng.randrange(9)}"
        level = 900 + size * (2 if kind == "a" else 1) + 40 * mon * (place in ("p1", "p4", "p7"))
        found.append((size, mon, kind, place, level + rng.gauss(0, 60), mon * size % 37 + rng.random(), float(rng.randrange(1, 30))))
    return spark.createDataFrame(found, "size int, mon int, kind string, place string, income double, tax double, weight double")


@pytest.fixture(scope="module")
def ready(rows):
    prepared = Pipeline(stages=X.feature_stages(rows, KINDS, NUMBERS, flags=False)).fit(rows)
    return prepared, M.materialize(prepared.transform(rows).select(X.FEATURES, "income", "tax", M.WEIGHT).coalesce(1), "boosting")


def makers(trees, max_bins=16):
    return [M.boosted_trees(m, trees, max_bins=max_bins).setWeightCol(M.WEIGHT) for m in ("income", "tax")]


def predicted(models, rows):
    for model in models:
        rows = model.transform(rows)
    return np.array(rows.select(*[m.getPredictionCol() for m in models]).collect())


@pytest.fixture(params=["in order", "by bins"])
def way(request, monkeypatch):
    if request.param == "by bins":
        monkeypatch.setattr(B, "IN_ORDER", 0)


def jobs(spark):
    return spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()


def test_a_round_takes_no_job(spark, rows):
    wide = rows.withColumnsRenamed({"kind": "season", "place": "tax_type", "size": "employees_count"}).withColumns({
        "taxpayer_type": F.lit("SZ"), "activity_type": F.lit("IT"), "registration_district": F.lit("x"),
        "yr": F.lit(2020), "has_employees": F.lit(True), "transactions": F.col("income") / 10,
    })
    wide = M.materialize(wide.drop(M.WEIGHT).limit(200), "wide")
    before = jobs(spark)
    M.fit_forecast(wide, trees=2)
    between = jobs(spark)
    model = M.fit_forecast(wide, trees=12)
    assert jobs(spark) - between == between - before
    assert [len(m.trees) for m in model.stages[-3:]] == [12, 12, 12]


def test_trees_are_those_of_mllib(ready, way):
    _, rows = ready
    found, known = B.fit_all(rows, makers(8)), B.fit_spread(rows, makers(8))
    np.testing.assert_allclose(predicted(found, rows), predicted(known, rows), rtol=1e-9)
    for a, b in zip(found, known):
        assert a.treeWeights == b.treeWeights and a.totalNumNodes == b.totalNumNodes
        np.testing.assert_allclose(a.featureImportances.toArray(), b.featureImportances.toArray(), rtol=1e-6, atol=1e-9)
        assert a.extractParamMap() and a.getMaxIter() == b.getMaxIter() and a.getLabelCol() == b.getLabelCol()


def test_pieces_and_order_do_not_matter(ready, monkeypatch):
    _, rows = ready
    monkeypatch.setattr(B, "IN_ORDER", 0)
    one, many = B.fit_all(rows, makers(6)), B.fit_all(M.materialize(rows.repartition(7, "income"), "dealt"), makers(6))
    np.testing.assert_allclose(predicted(one, rows), predicted(many, rows), rtol=1e-12)


def test_equal_splits_take_the_first_input(spark, way):
    rows = spark.createDataFrame([(float(i), float(i * 10), float(i > 3), 1.0) for i in range(8)], "a double, b double, income double, weight double")
    prepared = Pipeline(stages=X.feature_stages(rows, [], ["a", "b"], flags=False)).fit(rows)
    maker = M.boosted_trees("income", 3).setWeightCol(M.WEIGHT)
    [model] = B.fit_all(M.materialize(prepared.transform(rows).select(X.FEATURES, "income", M.WEIGHT), "equal"), [maker])
    assert list(model.featureImportances.toArray()) == [1.0, 0.0]
    assert model.trees[0].numNodes == 3  # what is left is nothing


def test_equal_splits_fall_as_in_mllib(spark):
    # The second input is the first in other words, and the third says the same of most rows.
    rng = random.Random(9)
    rows = spark.createDataFrame([
        (i % 12, f"q{i % 12 // 3}", "xyz"[i % 12 // 4] if i % 50 else "z", rng.gauss(50, 9), rng.random() * 3, float(rng.randrange(1, 9)))
        for i in range(400)
    ], "mon int, quarter string, third string, income double, tax double, weight double")
    prepared = Pipeline(stages=X.feature_stages(rows, ["quarter", "third"], ["mon"], flags=False)).fit(rows)
    stored = M.materialize(prepared.transform(rows).select(X.FEATURES, "income", "tax", M.WEIGHT).coalesce(1), "ties")
    for a, b in zip(B.fit_all(stored, makers(25)), B.fit_spread(stored, makers(25))):
        assert a.toDebugString.split("\n")[1:] == b.toDebugString.split("\n")[1:]


def test_rows_beyond_one_task_are_left_to_mllib(ready, monkeypatch):
    _, rows = ready
    whole = predicted(B.fit_all(rows, makers(3)), rows)
    for name in ("ROWS", "VALUES", "BINS"):
        with monkeypatch.context() as m:
            m.setattr(B, name, 10)
            m.setattr(B, "IN_ORDER", 0)
            m.setattr(B, "fit_in_task", None)
            np.testing.assert_allclose(predicted(B.fit_all(rows, makers(3)), rows), whole, rtol=1e-9)


def test_no_rows_are_an_error(ready):
    with pytest.raises(Exception):
        B.fit_all(M.materialize(ready[1].limit(0), "none"), makers(2))


def test_scores_are_those_of_mllib(spark, rows, ready):
    prepared, stored = ready
    model = PipelineModel([*prepared.stages, *B.fit_all(stored, makers(12))])
    # Values between and beyond those learned from, an unseen category and nulls.
    other = rows.limit(60).unionByName(spark.createDataFrame(
        [(-5, 0, "z", "p1", 1.0, None, 1.0), (9999, 13, None, None, None, 2.0, 1.0), (None, None, "a", "new", 3.0, 3.0, 1.0)], rows.schema
    )).withColumn("key", F.monotonically_increasing_id())
    found = {r["key"]: r for r in B.transform(model, other, ["key", "tax"]).collect()}
    known = model.transform(other).collect()
    assert len(found) == len(known) == 63
    for r in known:
        assert found[r["key"]]["tax"] == r["tax"]
        for m in ("predicted_income", "predicted_tax"):
            assert found[r["key"]][m] == pytest.approx(r[m], rel=1e-12)


def test_stages_after_the_trees_are_kept(rows, ready):
    prepared, stored = ready
    [tree, _] = B.fit_all(stored, makers(2))
    from pyspark.ml.feature import SQLTransformer

    back = SQLTransformer(statement="select *, 2 * predicted_income as twice from __THIS__")
    model = PipelineModel([*prepared.stages, tree, back])
    few = rows.limit(20)
    assert "twice" in B.transform(model, few, ["tax"]).columns
    pairs = M.labelled_predictions(model, few, ["income"], {"income": "twice"}).collect()
    assert sorted(r["y_pred"] for r in pairs) == sorted(r["twice"] for r in model.transform(few).collect())
