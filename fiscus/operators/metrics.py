"""Quality of predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiscus.functions.scalars import stable_digest
from fiscus.operators.medians import exact_median
from fiscus.session import materialize

METRICS = (
    "mae", "rmse", "mse", "r2", "mape", "median_ae", "max_error", "observations",
)


def regression_metrics(
    df: DataFrame,
    actual: str = "y_test",
    predicted: str = "y_pred",
    by: Sequence[str] = (),
    stored: bool = False,
) -> DataFrame:
    """MAE, RMSE, MSE, R2, MAPE, median and largest error, number of rows, per group.

    One aggregate gives everything but the median error, whose group can be the whole
    table. The rows are scanned a few times: ``stored`` says that they are a plain table;
    rows that come out of a model are scored once and their errors stored. MAPE leaves out rows whose actual value is 0 and is null when none is left. As
    usual for R2, a constant target gives 1 if every prediction is right and 0 if not.
    """
    by = list(by)
    error = F.abs(F.col(actual) - F.col(predicted))
    # Rows with a missing side are not observations.
    terms = df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull()).select(
        *by, F.col(actual).alias("y"), error.alias("e")
    )
    if not stored:
        terms = materialize(terms, "errors")
    residual = F.sum(F.col("e") * F.col("e"))
    spread = F.var_pop("y") * F.count("y")
    r2 = F.when(spread > 0, F.lit(1.0) - F.try_divide(residual, spread)).otherwise(
        F.when(residual == 0, 1.0).otherwise(0.0)
    )
    percent = F.avg(F.when(F.col("y") != 0, F.col("e") / F.abs(F.nullif("y", F.lit(0.0))))) * 100
    main = terms.groupBy(*by).agg(
        F.avg("e").alias("mae"),
        F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"),
        F.avg(F.col("e") * F.col("e")).alias("mse"),
        r2.alias("r2"),
        percent.alias("mape"),
        F.max("e").alias("max_error"),
        F.count("y").alias("observations"),
    )
    middle = exact_median(terms, by, ["e"], stored=True).withColumnRenamed("e", "median_ae")
    if not by:
        return main.withColumn("median_ae", middle.scalar()).select(*METRICS)
    middle = middle.withColumnsRenamed({k: f"middle_{k}" for k in by})
    match = [F.col(k).eqNullSafe(F.col(f"middle_{k}")) for k in by]
    return main.join(middle, match).select(*by, *METRICS)


def ideal_line(df: DataFrame, actual: str = "y_test", predicted: str = "y_pred") -> DataFrame:
    """Ends of the 'prediction equals actual' line."""
    return df.agg(
        F.least(F.min(actual), F.min(predicted)).alias("min_val"),
        F.greatest(F.max(actual), F.max(predicted)).alias("max_val"),
    )


def sample_rows(df: DataFrame, keys: Sequence[str], n: int = 100, seed: int = 42) -> DataFrame:
    """``n`` random rows, the same ones on every run: the lowest digests of the row key.

    A per-partition top-n, with no shuffle of the rows, and no dependence on partitioning.
    """
    return df.orderBy(stable_digest(seed, *keys), *keys).limit(n)
