"""Medians from quantile sketches that can be merged: an opt-in for marts that must not reread facts.

One sketch is kept for each of the finest groups; any coarser group merges the sketches below it. A
sketch has a fixed size whatever the rows it stands for. A median from it is a value of the group
whose rank is off the middle by at most ``rank_error`` of the rows, with a confidence of 99 %.
Groups of no more than ``k`` values are kept whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fiscus.schemas import MEASURES

#: Values a sketch keeps in its top level; the space is about three times that.
K = 800


def rank_error(k: int = K) -> float:
    """Published error of a single rank for this kind of sketch, as a share of the rows."""
    return 2.296 / k**0.9021


def sketched(df: DataFrame, keys: Sequence[str], measures: Sequence[str] = MEASURES, k: int = K) -> DataFrame:
    """One sketch for each measure and group; nulls are left out. Partial sketches are merged before the shuffle."""
    return df.groupBy(*keys).agg(
        *[F.kll_sketch_agg_double(F.col(m).cast("double"), F.lit(k)).alias(m) for m in measures]
    )


def merged(sketches: DataFrame, keys: Sequence[str], measures: Sequence[str] = MEASURES, k: int = K) -> DataFrame:
    """Sketches of coarser groups from those of finer ones; no fact is read."""
    return sketches.groupBy(*keys).agg(*[F.kll_merge_agg_double(m, F.lit(k)).alias(m) for m in measures])


def quantile(sketch: str, share: float = 0.5) -> Column:
    """A value of the group at about this share of its ranks; null if the group holds nothing."""
    filled = F.kll_sketch_get_n_double(sketch) > 0
    return F.when(filled, F.kll_sketch_get_quantile_double(sketch, F.lit(share)))


def medians(sketches: DataFrame, keys: Sequence[str], measures: Sequence[str] = MEASURES) -> DataFrame:
    """Approximate medians and how many values each stands for (``n_`` and the measure)."""
    return sketches.select(
        *keys, *[quantile(m).alias(m) for m in measures],
        *[F.kll_sketch_get_n_double(m).alias(f"n_{m}") for m in measures],
    )


def by_type_with_total(sketches: DataFrame, keys: Sequence[str], measures: Sequence[str] = MEASURES, k: int = K) -> DataFrame:
    """Sketches per regime and, with a null regime, of all together, like ``aggregates.by_type_with_total``."""
    own = sketches.where(F.col("tax_type").isNotNull())
    total = merged(sketches, keys, measures, k).withColumn("tax_type", F.lit(None).cast("string"))
    return merged(own, [*keys, "tax_type"], measures, k).unionByName(total)
