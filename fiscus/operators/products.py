"""Linear fits from sums of products, learned once for all folds, strengths and targets.

All a ridge fit needs of its rows is the matrix of products of their columns, and such matrices add
up. The columns kept here are more than the features: each number as it is or 0, and a mark where it
is null; a flag for each value of a category, and one for null. Filling nulls, with whatever was
learned from whichever rows, is then a linear map of the columns and so of the matrix. One matrix
for each fold therefore answers for every choice of held-out fold with fills, scales and categories
that come from the other folds alone: their counts are in the matrix, and the medians of all
complements come from one pass.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.common import _py2java
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexerModel, VectorAssembler
from pyspark.ml.linalg import DenseVector
from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fiscus.operators.features import FEATURES, sql_text, with_fold
from fiscus.operators.medians import exact_median
from fiscus.session import materialize

#: Stands for null among the values of a category; no value is this.
NULL = "\x01null"


@dataclass(frozen=True)
class Fills:
    """What was learned from some of the folds: a number for each null number, a value for each null category."""

    numbers: dict[str, float]
    modes: dict[str, str | None]


@dataclass(frozen=True)
class Products:
    """Sums of products by fold. Numbers are stored as (value - shift) / unit, for precision only."""

    spark: SparkSession
    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    labels: tuple[str, ...]
    units: dict[str, tuple[float, float]]
    levels: dict[str, list[str]]
    folds: list[np.ndarray]
    medians: list[dict[str, float]]  # of the rows outside each fold; the last of all rows

    @property
    def width(self) -> int:
        """Features after filling."""
        return len(self.numeric) + sum(len(self.levels[c]) for c in self.categorical)

    def outside(self, fold: int | None = None) -> np.ndarray:
        """The sums over all other folds, or over all."""
        return sum(p for k, p in enumerate(self.folds) if k != fold)

    def fills(self, fold: int | None = None) -> Fills:
        """Modes (the smallest value on a tie) and medians of all rows outside a fold."""
        sums = self.outside(fold)[-1]
        modes, at = {}, 2 * len(self.numeric)
        for c in self.categorical:
            counts = sums[at:at + len(self.levels[c])]
            modes[c] = self.levels[c][int(counts.argmax())] if len(counts) and counts.max() > 0 else None
            at += len(counts) + 1
        known = self.medians[-1 if fold is None else fold]
        return Fills({c: known.get(c, 0.0) for c in self.numeric}, modes)

    def mapped(self, sums: np.ndarray, fills: Fills, label: str) -> np.ndarray:
        """The matrix of the filled features, one label and 1."""
        n, old = len(self.numeric), len(sums)
        move = np.zeros((old, self.width + 2))
        for j, c in enumerate(self.numeric):
            shift, unit = self.units[c]
            move[j, j] = 1.0
            move[n + j, j] = (fills.numbers[c] - shift) / unit
        at, to = 2 * n, n
        for c in self.categorical:
            for level in self.levels[c]:
                move[at, to] = 1.0
                if level == fills.modes[c]:
                    move[at + len(self.levels[c]) - self.levels[c].index(level), to] = 1.0
                at, to = at + 1, to + 1
            at += 1
        move[at + self.labels.index(label), -2] = 1.0
        move[-1, -1] = 1.0
        return move.T @ sums @ move

    def held_out_r2(self, alpha: float, label: str) -> float:
        """Mean over the folds of the R2 that the fit on the other folds has on the fold."""
        scores = []
        for k, own in enumerate(self.folds):
            fills = self.fills(k)
            scores.append(r2(*solve(self.mapped(self.outside(k), fills, label), alpha, len(self.numeric)), self.mapped(own, fills, label)))
        return float(np.mean(scores))

    def model(self, alphas: dict[str, float]) -> PipelineModel:
        """The ridge fit of each label on all folds as one pipeline; numbers are scaled, categories become flags."""
        fills = self.fills()
        stages, scales = None, None
        fitted = []
        for label, alpha in alphas.items():
            whole = self.mapped(self.outside(), fills, label)
            if stages is None:
                scales = self._scales(whole)
                stages = self._stages(fills, scales)
            slope, level = solve(whole, alpha, len(self.numeric))
            for j, c in enumerate(self.numeric):
                # From stored units to scaled ones.
                mean, dev = ((scales[c][0] - self.units[c][0]) / self.units[c][1], scales[c][1] / self.units[c][1])
                level += slope[j] * mean
                slope[j] *= dev
            fitted.append(linear_model(self.spark, slope, level, f"predicted_{label}"))
        return PipelineModel([*stages, *fitted])

    def _scales(self, whole: np.ndarray) -> dict[str, tuple[float, float]]:
        """Mean and population deviation of each filled number."""
        found, n = {}, whole[-1, -1]
        for j, c in enumerate(self.numeric):
            mean = whole[j, -1] / n
            variance = whole[j, j] / n - mean * mean
            shift, unit = self.units[c]
            found[c] = (float(shift + unit * mean), float(unit * np.sqrt(variance)) if variance > 1e-14 else 1.0)
        return found

    def _stages(self, fills: Fills, scales: dict[str, tuple[float, float]]) -> list:
        parts = [f"coalesce(cast({c} as string), {sql_text(fills.modes[c] or NULL)}) as {c}_text" for c in self.categorical]
        parts += [f"(coalesce(cast({c} as double), {fills.numbers[c]!r}D) - {scales[c][0]!r}D) / {scales[c][1]!r}D as {c}_number" for c in self.numeric]
        used = [c for c in self.categorical if self.levels[c]]
        stages: list = [SQLTransformer(statement=f"select *, {', '.join(parts)} from __THIS__")]
        if used:
            stages += flag_stages(self.spark, {c: self.levels[c] for c in used}, handle="keep", drop_last=True)
        inputs = [*[f"{c}_number" for c in self.numeric], *[f"{c}_flags" for c in used]]
        return [*stages, VectorAssembler(inputCols=inputs, outputCol=FEATURES)]


def flag_stages(spark: SparkSession, levels: dict[str, list[str]], handle: str, drop_last: bool) -> list:
    """Stages from ``<name>_text`` to ``<name>_flags`` for known values; nothing is read to fit them."""
    texts, indexes, flags = ([f"{c}_{x}" for c in levels] for x in ("text", "index", "flags"))
    numbered = [
        StringIndexerModel.from_labels(values, inputCol=text, outputCol=index, handleInvalid=handle)
        for values, text, index in zip(levels.values(), texts, indexes, strict=True)
    ]
    empty = PipelineModel(numbered).transform(spark.createDataFrame([], ", ".join(f"`{t}` string" for t in texts)))
    return [*numbered, OneHotEncoder(inputCols=indexes, outputCols=flags, dropLast=drop_last).fit(empty)]


def linear_model(spark: SparkSession, slope: np.ndarray, level: float, prediction: str) -> LinearRegressionModel:
    """A model of MLlib with these coefficients, which can be saved like any other."""
    vector = _py2java(spark.sparkContext, DenseVector(slope))
    name = f"ridge_{prediction}"
    made = spark._jvm.org.apache.spark.ml.regression.LinearRegressionModel(name, vector, float(level), 1.0)
    made.setFeaturesCol(FEATURES)
    made.setPredictionCol(prediction)
    model = LinearRegressionModel(made)
    model._resetUid(made.uid())
    model._transfer_params_from_java()
    return model


def solve(whole: np.ndarray, alpha: float, numbers: int) -> tuple[np.ndarray, float]:
    """Slopes and level of the ridge fit to a matrix of (features, label, 1); no penalty on the level.

    The first ``numbers`` features are numbers: a penalty on the slope of a scaled number is one on
    the slope times the number's deviation.
    """
    n, sums = whole[-1, -1], whole[-1, :-1]
    centred = whole[:-1, :-1] - np.outer(sums, sums) / n
    penalty = np.ones(len(sums) - 1)
    variance = np.diag(centred)[:numbers] / n
    penalty[:numbers] = np.where(variance > 1e-14, variance, 1.0)
    slope = np.linalg.solve(centred[:-1, :-1] + alpha * np.diag(penalty), centred[:-1, -1])
    return slope, float((sums[-1] - sums[:-1] @ slope) / n)


def r2(slope: np.ndarray, level: float, rows: np.ndarray) -> float:
    """R2 of a line on the rows behind a matrix of (features, label, 1)."""
    weights = np.concatenate([-slope, [1.0, -level]])
    spread = rows[-2, -2] - rows[-1, -2] ** 2 / rows[-1, -1]
    return float(1.0 - (weights @ rows @ weights) / spread)


def learn(train: DataFrame, labels: Sequence[str], numeric: Sequence[str], categorical: Sequence[str], folds: int = 1) -> Products:
    """Read the rows once for what the columns hold, once to store them with their folds, and twice for the matrices.

    ``train`` should be a stored table. Rows without a label are left out, numbers that are never known too.
    Folds come from a digest of the row key, so they do not depend on how rows are spread.
    """
    spark = train.sparkSession
    for label in labels:
        train = train.where(F.col(label).isNotNull())
    doubles = {c: F.col(c).cast("double") for c in numeric}
    found = train.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.struct(F.count(v), F.avg(v), F.stddev_pop(v)).alias(f"n_{c}") for c, v in doubles.items()],
        *[F.collect_set(F.col(c).cast("string")).alias(f"c_{c}") for c in categorical],
    ).first()
    known = [c for c in numeric if found[f"n_{c}"][0]]
    units = {c: (float(found[f"n_{c}"][1]), float(found[f"n_{c}"][2] or 1.0)) for c in known}
    levels = {c: sorted(found[f"c_{c}"], key=str.encode) for c in categorical}
    rows = train if folds == 1 else with_fold(train, folds)
    marks = [F.coalesce((doubles[c] - units[c][0]) / units[c][1], F.lit(0.0)).alias(f"{c}_value") for c in known]
    marks += [F.when(F.col(c).isNull(), 1.0).otherwise(0.0).alias(f"{c}_null") for c in known]
    texts = [F.coalesce(F.col(c).cast("string"), F.lit(NULL)).alias(f"{c}_text") for c in categorical]
    gaps = [c for c in known if found[f"n_{c}"][0] < found["rows"]]
    fold = F.lit(0).alias("fold") if folds == 1 else F.col("fold")
    wide = rows.select(*marks, *texts, *[F.col(m).cast("double").alias(f"{m}_label") for m in labels], F.lit(1.0).alias("one"), fold, *[doubles[c].alias(c) for c in gaps])
    stored = materialize(wide, "folds")
    numbers = [*[f"{c}_value" for c in known], *[f"{c}_null" for c in known]]
    sums = product_sums(stored, numbers, {c: [*levels[c], NULL] for c in categorical}, [*[f"{m}_label" for m in labels], "one"], folds)
    return Products(spark, tuple(known), tuple(categorical), tuple(labels), units, levels, sums, complement_medians(stored, gaps, folds))


def product_sums(
    rows: DataFrame, before: Sequence[str], levels: dict[str, list[str]], after: Sequence[str], folds: int
) -> list[np.ndarray]:
    """For each fold the sums of products of the numbers ``before``, a flag for each level, and the numbers ``after``.

    Flags are never laid out. A product of two is a count, and one of a flag and a number is a sum over the
    level's rows; both come from the sums of each combination of levels, which are few beside the rows.
    """
    dense = [*before, *after]
    flags = [(c, level) for c, found in levels.items() for level in found]
    flag_at = {flag: len(before) + i for i, flag in enumerate(flags)}
    at = [*range(len(before)), *range(len(before) + len(flags), len(dense) + len(flags))]
    found = [np.zeros((len(dense) + len(flags),) * 2) for _ in range(folds)]
    pairs = [(i, j) for i in range(len(dense)) for j in range(i, len(dense))]
    products = rows.groupBy("fold").agg(*[F.sum(F.col(dense[i]) * F.col(dense[j])) for i, j in pairs])
    for fold, *values in products.collect():
        for (i, j), value in zip(pairs, values, strict=True):
            found[fold][at[i], at[j]] = found[fold][at[j], at[i]] = value
    if not levels:
        return found
    names = list(levels)
    combined = rows.groupBy("fold", *[f"{c}_text" for c in names]).agg(*[F.sum(d).alias(d) for d in dense])
    met = F.explode(F.array(*[
        F.struct(F.lit(a).alias("a"), F.col(f"{a}_text").alias("x"), F.lit(b).alias("b"), F.col(f"{b}_text").alias("y"))
        for i, a in enumerate(names) for b in names[i:]
    ]))
    # As many rows as the matrix has places.
    each = combined.select("fold", *dense, met.alias("met")).groupBy("fold", "met.a", "met.x", "met.b", "met.y").agg(*[F.sum(d).alias(d) for d in dense])
    for fold, a, x, b, y, *values in each.collect():
        i, j = flag_at[a, x], flag_at[b, y]
        found[fold][i, j] = found[fold][j, i] = values[-1]
        if i == j:
            found[fold][i, at] = found[fold][at, i] = values
    return found


def complement_medians(stored: DataFrame, columns: Sequence[str], folds: int) -> list[dict[str, float]]:
    """Exact medians of the rows outside each fold, and of all rows: every row counts in all sets but one."""
    if not columns:
        return [{} for _ in range(folds + 1)]
    others = F.array_except(F.sequence(F.lit(0), F.lit(folds)), F.array("fold"))
    sets = stored.select(F.explode(others).alias("outside"), *columns)
    found = {r["outside"]: r.asDict() for r in exact_median(sets, ["outside"], list(columns), stored=True).collect()}
    return [{c: found[k][c] for c in columns if k in found and found[k][c] is not None} for k in range(folds + 1)]
