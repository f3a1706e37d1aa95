"""Splitting, filling, scaling and encoding of model inputs.

What is learned from the data (fill values, means, category lists) is a handful of numbers
per column, so it is read back once and put into the plan as literals; applying it never
shuffles or joins. As pipeline stages the same literals are saved with the model.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.base import Estimator, Transformer
from pyspark.ml.feature import (
    OneHotEncoder,
    SQLTransformer,
    StringIndexer,
    StringIndexerModel,
    VectorAssembler,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiscus.functions.scalars import stable_digest
from fiscus.operators.medians import exact_median

CATEGORICAL = (
    "season", "tax_type", "taxpayer_type", "activity_type", "registration_district",
)
NUMERIC = ("yr", "mon", "has_employees", "employees_count")
FACT_KEY = ("taxpayer_id", "yr", "mon", "tax_type")
FEATURES = "features"


def _threshold(share: float) -> str:
    """Digests below this eight-digit hex text make up ``share`` of all digests."""
    return format(int(share * 2**32), "08x")


def split_train_test(
    df: DataFrame,
    keys: Sequence[str] = FACT_KEY,
    test_share: float = 0.2,
    seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """Split by a digest of the row key.

    A row is always on the same side, whatever the partitioning and however often a lost
    task is run again; a random split would reshuffle rows between the two sides.
    """
    in_train = stable_digest(seed, *keys) < F.lit(_threshold(1 - test_share))
    return df.where(in_train), df.where(~in_train)


def with_fold(df: DataFrame, folds: int, keys: Sequence[str] = FACT_KEY, seed: int = 43) -> DataFrame:
    """Fold number from 0 by a digest of the row key; its seed is not that of the split."""
    leading = F.conv(F.substring(stable_digest(seed, *keys), 1, 8), 16, 10).cast("long")
    number = F.pmod(leading, F.lit(folds)).cast("int")
    return df.withColumn("fold", number)


def most_frequent(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Most frequent value of each column, the smallest on a tie; nulls do not count.

    Values of all columns are counted in one pass, then the few counts are compared.
    """
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value"))
        for c in columns
    ]))
    counts = (
        df.select(pairs.alias("p")).select("p.*").where("value is not null")
        .groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    )
    first = F.min(F.struct((-F.col("n")).alias("rank"), F.col("value")))
    return counts.groupBy("feature").agg(first.alias("top")).select(
        "feature", F.col("top.value").alias("value"), (-F.col("top.rank")).alias("n")
    )


def mode_fills(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    return {r["feature"]: r["value"] for r in most_frequent(df, columns).collect()}


def median_fills(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Medians of the columns that have any value at all; ``df`` should be a stored table."""
    numbers = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    row = exact_median(numbers, [], list(columns), stored=True).first().asDict()
    return {c: v for c, v in row.items() if v is not None}


def fill(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return df.withColumns({
        c: F.coalesce(F.col(c), F.lit(v).cast(df.schema[c].dataType)) for c, v in values.items()
    })


def fill_doubles(df: DataFrame, values: Mapping[str, float]) -> DataFrame:
    return df.withColumns({
        c: F.coalesce(F.col(c).cast("double"), F.lit(float(v))) for c, v in values.items()
    })


def known_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """The columns with at least one value; a column of nulls teaches a model nothing."""
    row = df.agg(*[F.count(c).alias(c) for c in columns]).first()
    return [c for c in columns if row[c]]


def scale_of(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each column; a constant column is not divided."""
    stats = [F.avg(F.col(c).cast("double")).alias(f"{c}_mean") for c in columns]
    stats += [F.stddev_pop(F.col(c).cast("double")).alias(f"{c}_dev") for c in columns]
    row = df.agg(*stats).first()
    return {c: (row[f"{c}_mean"] or 0.0, row[f"{c}_dev"] or 1.0) for c in columns}


def standardize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Zero mean and unit population deviation."""
    return df.withColumns({
        c: (F.col(c).cast("double") - F.lit(mean)) / F.lit(dev)
        for c, (mean, dev) in scale_of(df, columns).items()
    })


def sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def feature_stages(
    train: DataFrame,
    categorical: Sequence[str] = CATEGORICAL,
    numeric: Sequence[str] = NUMERIC,
    fills: str = "learned",
    scaled: bool = False,
    flags: bool = True,
) -> list[Estimator | Transformer]:
    """Pipeline stages from raw columns to one ``features`` vector.

    ``train`` is read several times and should be a stored table.
    ``fills='learned'`` puts the most frequent category and the median in place of nulls,
    ``fills='constant'`` puts 'Unknown' and 0. Categories become 0/1 columns; one that was
    not seen in training becomes all zeros. Trees split on whole categories, so for them
    ``flags=False`` leaves each category as one numbered column, in which everything unseen
    shares a number: far fewer columns to scan per split.
    """
    if fills == "learned":
        texts = mode_fills(train, categorical) if categorical else {}
        numbers = median_fills(train, numeric) if numeric else {}
    elif fills == "constant":
        texts, numbers = {}, {}
    else:
        raise ValueError(f"unknown fills {fills!r}")
    numbers = {c: numbers.get(c, 0.0) for c in numeric}
    scales = {c: (0.0, 1.0) for c in numeric}
    if scaled and numeric:
        scales = scale_of(fill_doubles(train, numbers), numeric)
    parts = [
        f"coalesce(cast({c} as string), {sql_text(texts.get(c, 'Unknown'))}) as {c}_text"
        for c in categorical
    ]
    parts += [
        f"(coalesce(cast({c} as double), {numbers[c]!r}D) - {scales[c][0]!r}D)"
        f" / {scales[c][1]!r}D as {c}_number"
        for c in numeric
    ]
    encode = [] if not categorical else [
        StringIndexer(
            inputCols=[f"{c}_text" for c in categorical],
            outputCols=[f"{c}_index" for c in categorical],
            handleInvalid="keep",
            stringOrderType="alphabetAsc",
        ),
    ]
    if categorical and flags:
        encode.append(OneHotEncoder(
            inputCols=[f"{c}_index" for c in categorical],
            outputCols=[f"{c}_flags" for c in categorical],
            dropLast=True,
        ))
    kind = "flags" if flags else "index"
    return [
        SQLTransformer(statement=f"select *, {', '.join(parts)} from __THIS__"),
        *encode,
        VectorAssembler(
            inputCols=[*[f"{c}_number" for c in numeric], *[f"{c}_{kind}" for c in categorical]],
            outputCol=FEATURES,
        ),
    ]


def feature_names(
    model: PipelineModel,
    categorical: Sequence[str] = CATEGORICAL,
    numeric: Sequence[str] = NUMERIC,
) -> list[str]:
    """Name of each position of the ``features`` vector of a fitted pipeline."""
    seen = [labels for s in model.stages if isinstance(s, StringIndexerModel) for labels in s.labelsArray]
    return [
        *numeric,
        *[f"{c}_{label}" for c, labels in zip(categorical, seen) for label in labels],
    ]
