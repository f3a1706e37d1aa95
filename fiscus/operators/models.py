"""Regression models on MLlib.

Training reads its input many times, so the joined input is written once to the shared
folder first; every pass then scans narrow Parquet, and a lost executor costs a re-read.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.base import Estimator
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fiscus.functions.lookups import ECON_SCENARIO
from fiscus.functions.scalars import clip_range, season
from fiscus.operators.boosting import fit_all, transform
from fiscus.operators.features import (
    CATEGORICAL,
    FACT_KEY,
    FEATURES,
    NUMERIC,
    feature_names,
    feature_stages,
    known_columns,
)
from fiscus.operators.joins import facts_with_payers, with_months
from fiscus.operators.products import Products, learn
from fiscus.schemas import MEASURES
from fiscus.session import materialize

# Size of the boosted trees, and the strengths tried for ridge.
TREES = 500
TREE_DEPTH = 5
LEARNING_RATE = 0.05
MAX_BINS = 64
SEED = 42
ALPHAS = (0.1, 1.0, 5.0, 10.0, 50.0, 100.0)
FOLDS = 5

# Ranges the logged targets are cut to before training.
LOG_RANGES = {"income": (5_000.0, 500_000.0), "transactions": (0.0, 500.0)}

ECON = tuple(ECON_SCENARIO)
WEIGHT = "weight"


def training_input(
    facts: DataFrame, payers: DataFrame, econ: DataFrame | None = None
) -> DataFrame:
    """Facts with payer attributes, season and, if given, the month's economy; stored once."""
    rows = facts_with_payers(facts, payers)
    if econ is not None:
        rows = with_months(rows, materialize(econ, "months"))
        rows = rows.withColumns({
            c: F.lit(None).cast("double") for c in ECON if c not in rows.columns
        })
    names = [*FACT_KEY, *[c for c in (*CATEGORICAL, *NUMERIC) if c not in (*FACT_KEY, "season")]]
    economy = list(ECON) if econ is not None else []
    stored = materialize(
        rows.select(
            *names,
            season(F.col("mon")).alias("season"),
            *[F.col(m).cast("double").alias(m) for m in MEASURES],
            *economy,
        ),
        "training",
    )
    # Training is bound by computing, so a table in fewer pieces than there are cores, which
    # is a small one, is spread over all of them.
    cores = stored.sparkSession.sparkContext.defaultParallelism
    if stored.rdd.getNumPartitions() < cores:
        stored = materialize(stored.repartition(cores, *FACT_KEY), "training")
    return stored


def boosted_trees(
    label: str,
    trees: int = TREES,
    depth: int = TREE_DEPTH,
    rate: float = LEARNING_RATE,
    max_bins: int = MAX_BINS,
) -> GBTRegressor:
    """``max_bins`` must be at least the number of values of the widest category (``bins_for``)."""
    return GBTRegressor(
        featuresCol=FEATURES,
        labelCol=label,
        predictionCol=f"predicted_{label}",
        lossType="squared",
        maxIter=trees,
        maxDepth=depth,
        maxBins=max_bins,
        stepSize=rate,
        seed=SEED,
    )


def linear(label: str, prediction: str | None = None) -> LinearRegression:
    """Least squares from one pass over the data (normal equations)."""
    return LinearRegression(
        featuresCol=FEATURES,
        labelCol=label,
        predictionCol=prediction or f"predicted_{label}",
        solver="normal",
        standardization=False,
        regParam=1e-6,
    )


def ridge_strength(train: DataFrame, label: str) -> float:
    """What to multiply a ridge alpha by to get MLlib's ``regParam``.

    MLlib averages the squared errors and scales the label, so a penalty ``alpha`` on the
    sum of squares is ``alpha * deviation / n``.
    """
    row = train.agg(
        F.stddev_pop(label).alias("dev"), F.count(label).alias("n")
    ).first()
    return (row["dev"] or 1.0) / row["n"]


def ridge(label: str, reg_param: float) -> LinearRegression:
    return LinearRegression(
        featuresCol=FEATURES,
        labelCol=label,
        predictionCol=f"predicted_{label}",
        solver="normal",
        standardization=False,
        elasticNetParam=0.0,
        regParam=reg_param,
    )


def fit_targets(
    train: DataFrame, regressors: Sequence[Estimator], **features
) -> PipelineModel:
    """One pipeline: shared feature stages, then one regressor per target.

    The features are computed once per row at scoring time, however many targets there are.
    """
    stages = feature_stages(train, **features)
    return Pipeline(stages=[*stages, *regressors]).fit(train)


def fit_lines(train: DataFrame, inputs: Mapping[str, Sequence[str]]) -> PipelineModel:
    """Least squares for several targets, each from a few numeric inputs that are never null."""
    stages = []
    for label, names in inputs.items():
        stages.append(VectorAssembler(inputCols=list(names), outputCol=f"{label}_inputs"))
        stages.append(LinearRegression(
            featuresCol=f"{label}_inputs", labelCol=label, predictionCol=f"predicted_{label}",
            solver="normal", standardization=False, regParam=0.0,
        ))
    return Pipeline(stages=stages).fit(train)


def bins_for(train: DataFrame, categorical: Sequence[str] = CATEGORICAL) -> int:
    """Bins that hold every value of the widest category, and one more for null and one for the unseen."""
    widths = train.agg(*[F.count_distinct(c).alias(c) for c in categorical]).first()
    return max(MAX_BINS, *[n + 2 for n in widths])


def grouped(train: DataFrame, inputs: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """One row for each different set of inputs: the mean of each label, and how many rows it stands for.

    With squared errors a fit to these weighted means splits like one to the rows, as the spread within
    equal inputs cannot be split. There are at most as many as inputs have combinations, however many facts.
    """
    fine = train
    for label in labels:
        fine = fine.where(F.col(label).isNotNull())
    return fine.groupBy(*inputs).agg(*[F.avg(m).alias(m) for m in labels], F.count(F.lit(1)).cast("double").alias(WEIGHT))


def fit_forecast(train: DataFrame, trees: int = TREES) -> PipelineModel:
    """Boosted trees for income, transactions and tax, on grouped rows, all three at the same time."""
    prepared = Pipeline(stages=feature_stages(train, flags=False)).fit(train)
    groups = prepared.transform(grouped(train, (*CATEGORICAL, *NUMERIC), MEASURES))
    rows = materialize(groups.select(FEATURES, *MEASURES, WEIGHT), "grouped")
    bins = bins_for(train)
    models = fit_all(rows, [boosted_trees(m, trees, max_bins=bins).setWeightCol(WEIGHT) for m in MEASURES])
    return PipelineModel([*prepared.stages, *models])


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def ridge_inputs(train: DataFrame) -> list[str]:
    """Numeric inputs of the transactions model, without indicators that are never known."""
    wanted = [*NUMERIC, "income", *ECON]
    return known_columns(train, wanted)


def fit_best_ridge(train: DataFrame, label: str = "transactions", **inputs) -> PipelineModel:
    """The ridge model of the strength that the search finds best, from the sums the search has used."""
    sums = ridge_products(train, label, FOLDS, **inputs)
    scores = [sums.held_out_r2(alpha, label) for alpha in ALPHAS]
    return sums.model({label: ALPHAS[int(np.argmax(scores))]})


def ridge_products(
    train: DataFrame, label: str, folds: int, numeric: Sequence[str] | None = None,
    categorical: Sequence[str] = CATEGORICAL,
) -> Products:
    """``numeric``: the number inputs; by default those of the transactions model."""
    wanted = (*NUMERIC, "income", *ECON) if numeric is None else numeric
    return learn(train, [label], wanted, categorical, folds)


def fit_ridge(train: DataFrame, alpha: float = 1.0, label: str = "transactions", **inputs) -> PipelineModel:
    return ridge_products(train, label, 1, **inputs).model({label: alpha})


def fit_forecast_lines(train: DataFrame, alpha: float = 1.0) -> PipelineModel:
    """Ridge of income, transactions and tax on all inputs: three targets from one matrix of sums."""
    return learn(train, MEASURES, NUMERIC, CATEGORICAL).model(dict.fromkeys(MEASURES, alpha))


def search_ridge(
    train: DataFrame, alphas: Sequence[float] = ALPHAS, folds: int = FOLDS,
    label: str = "transactions", **inputs,
) -> DataFrame:
    """Mean R2 over the folds for each alpha, with the best one marked.

    Fills, scales and categories are learned anew for each held-out fold, from the others alone.
    """
    sums = ridge_products(train, label, folds, **inputs)
    scores = [sums.held_out_r2(alpha, label) for alpha in alphas]
    best = int(np.argmax(scores))
    return train.sparkSession.createDataFrame(
        [(float(a), r2, i == best) for i, (a, r2) in enumerate(zip(alphas, scores))],
        "alpha double, mean_r2 double, best boolean",
    )


def coefficients(
    model: PipelineModel, spark, numeric: Sequence[str], categorical: Sequence[str] = CATEGORICAL
) -> DataFrame:
    """(feature, coefficient) of a fitted linear pipeline."""
    values = [float(v) for v in model.stages[-1].coefficients.toArray()]
    names = feature_names(model, categorical, numeric)
    return spark.createDataFrame(list(zip(names, values)), "feature string, coefficient double")


def strongest_first(table: DataFrame, features: Sequence[str]) -> DataFrame:
    """The wanted features by size of their coefficient, whatever its sign."""
    return table.where(F.col("feature").isin(*features)).orderBy(
        F.abs("coefficient").desc(), "feature"
    )


def log_target(column: Column, label: str) -> Column:
    return F.log1p(clip_range(column.cast("double"), *LOG_RANGES[label]))


def fit_log_target(
    train: DataFrame, label: str, numeric: Sequence[str], trees: int | None = None
) -> PipelineModel:
    """Model of log(1 + target), cut to its usual range; predictions come back un-logged."""
    logged = train.withColumn(f"log_{label}", log_target(F.col(label), label))
    inner = f"predicted_log_{label}"
    regressor = linear(f"log_{label}", inner) if trees is None else boosted_trees(f"log_{label}", trees)
    back = SQLTransformer(
        statement=f"select *, expm1({inner}) as predicted_{label} from __THIS__"
    )
    stages = feature_stages(logged, numeric=numeric, fills="constant", scaled=True)
    return Pipeline(stages=[*stages, regressor, back]).fit(logged)


def fit_log_line(train: DataFrame, label: str, inputs: Sequence[str]) -> PipelineModel:
    """Least squares of log(1 + target), cut to its usual range, from a few numbers; un-logged again."""
    logged = train.withColumn(f"log_{label}", log_target(F.col(label), label))
    lines = fit_lines(logged, {f"log_{label}": inputs})
    back = SQLTransformer(statement=f"select *, expm1(predicted_log_{label}) as predicted_{label} from __THIS__")
    return PipelineModel([*lines.stages, back])


def fit_tax(train: DataFrame, numeric: Sequence[str], trees: int | None = None) -> PipelineModel:
    """Tax from every input, income and transactions included."""
    regressor = linear("tax") if trees is None else boosted_trees("tax", trees)
    return fit_targets(train, [regressor], numeric=numeric, fills="constant", scaled=True)


def predictions(model: PipelineModel, rows: DataFrame, label: str) -> DataFrame:
    """Actual and predicted values, in the layout the metrics read."""
    return model.transform(rows).select(
        F.col(label).alias("y_test"), F.col(f"predicted_{label}").alias("y_pred")
    )


def cut_actuals(sets: DataFrame) -> DataFrame:
    """Actual values cut to the ranges their logged targets were trained on."""
    cut = F.col("y_test")
    for label, limits in LOG_RANGES.items():
        cut = F.when(F.col("target") == label, clip_range(F.col("y_test"), *limits)).otherwise(cut)
    return sets.withColumn("y_test", cut)


def labelled_predictions(
    model: PipelineModel, rows: DataFrame, labels: Sequence[str], columns: Mapping[str, str] | None = None
) -> DataFrame:
    """(target, y_test, y_pred) for several targets out of a single scoring pass."""
    each = F.explode(F.array(*[
        F.struct(
            F.lit(m).alias("target"),
            F.col(m).alias("y_test"),
            F.col((columns or {}).get(m, f"predicted_{m}")).alias("y_pred"),
        )
        for m in labels
    ]))
    return transform(model, rows, list(labels)).select(each.alias("p")).select("p.*")
