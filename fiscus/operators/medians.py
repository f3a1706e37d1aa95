"""Exact medians for groups of any size.

Spark's own ``median`` keeps a value -> count map of a whole group in one task. That is the
best plan while the groups are known to fit, and a lost cause when one group holds a third
of a huge table. ``exact_median`` counts first:

* groups that are small, or a table that is small as a whole: the built-in aggregate;
* the other groups: narrow a bracket around the middle rank. Each pass is one scan in which a
  quantile sketch (fixed size, merged on the map side) proposes a tighter bracket and plain
  counts prove whether the middle rank lies inside. When few distinct values are left in
  every bracket, they are counted and ranked exactly. The brackets join the rows without a
  shuffle while there are few enough groups for Spark to broadcast them; the result
  never depends on the sketch being right.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fiscus.session import materialize

# Rows of one group a task may hold, while it may be holding many groups.
GROUP_LIMIT = 100_000
# Rows of a table so small that one task could hold all of it.
SMALL_TABLE = 2_000_000
SKETCH_ACCURACY = 10_000
GRID = 500


def exact_median(
    df: DataFrame,
    keys: Sequence[str],
    measures: Sequence[str],
    group_limit: int = GROUP_LIMIT,
    bounded_by_key: bool = False,
    stored: bool = False,
) -> DataFrame:
    """Median of each measure per group, nulls ignored, the middle two averaged.

    ``bounded_by_key`` says the keys themselves bound a group (a payer and a year hold at
    most twelve months of a few regimes), which makes the size check needless. Otherwise
    ``df`` is scanned more than once: ``stored`` says that it is a plain table, where a scan
    is all it costs; a derived frame is worked out once and its columns in use are stored.
    """
    keys = list(keys)
    if bounded_by_key:
        return builtin_median(df, keys, measures)
    if not stored:
        df = materialize(df.select(*keys, *measures), "median-input")
    largest, total = _sizes(df, keys)
    if largest <= group_limit or total <= SMALL_TABLE:
        return builtin_median(df, keys, measures)
    if not keys:
        return bracketed_median(df, keys, measures, group_limit)
    # Each large group has more than group_limit rows, so there are few of them; which
    # groups they are is stored, and so has a size Spark knows when it joins.
    n = F.count(F.lit(1)).alias("n")
    large = df.groupBy(*keys).agg(n).where(F.col("n") > group_limit).select(
        *[F.col(k).alias(f"large_{k}") for k in keys]
    )
    large = materialize(large, "large-groups")
    match = [F.col(k).eqNullSafe(F.col(f"large_{k}")) for k in keys]
    small = builtin_median(df.join(large, match, "left_anti"), keys, measures)
    return small.unionByName(
        bracketed_median(df.join(large, match, "left_semi"), keys, measures, group_limit)
    )


def builtin_median(df: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(
        *[F.median(F.col(m).cast("double")).alias(m) for m in measures]
    )


def _sizes(df: DataFrame, keys: list[str]) -> tuple[int, int]:
    """Rows of the largest group and of all groups."""
    if not keys:
        n = df.count()
        return n, n
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    largest, total = sizes.agg(F.max("n"), F.sum("n")).first()
    return largest or 0, total or 0


def bracketed_median(
    df: DataFrame,
    keys: Sequence[str],
    measures: Sequence[str],
    group_limit: int = GROUP_LIMIT,
) -> DataFrame:
    """``exact_median`` by bracketing, on a stored table; see the module text."""
    keys = list(keys)
    group = [*keys, "measure"]
    values = F.explode(F.array(*[
        F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("v"))
        for m in measures
    ]))
    long = df.select(*keys, values.alias("mv")).select(*keys, "mv.measure", "mv.v")

    brackets = materialize(
        long.groupBy(*group)
        .agg(
            F.count("v").alias("n"),
            F.min("v").alias("lo"),
            F.max("v").alias("hi"),
            _sketch(F.col("v")),
            F.approx_count_distinct("v").alias("variety"),
        )
        .withColumns({"below": F.lit(0).cast("long"), "inside": F.col("n")}),
        "median-brackets",
    )
    before = None
    while True:
        widest = brackets.where("lo < hi").agg(F.max("variety")).first()[0]
        # Each pass narrows the widest bracket many times over, unless the sketch misses.
        if widest is None or widest <= group_limit or widest == before:
            break
        before = widest
        brackets = _narrow(long, brackets, group)
    return _pick(long, brackets, keys, measures)


def _sketch(value):
    steps = F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])
    return F.percentile_approx(value, steps, SKETCH_ACCURACY).alias("grid")


def _middle_ranks():
    """Ranks (from 1) of the two middle values; the same rank twice when n is odd."""
    return F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1


def _narrow(long: DataFrame, brackets: DataFrame, group: list[str]) -> DataFrame:
    first, second = _middle_ranks()
    low_step = F.floor(F.try_divide(first - F.col("below"), F.col("inside")) * GRID) - 1
    high_step = F.ceil(F.try_divide(second - F.col("below"), F.col("inside")) * GRID) + 1
    proposed = brackets.select(
        *group, "n", "lo", "hi", "grid", "below", "inside", "variety",
        F.element_at("grid", F.greatest(low_step, F.lit(0)).cast("int") + 1).alias("new_lo"),
        F.element_at("grid", F.least(high_step, F.lit(GRID)).cast("int") + 1).alias("new_hi"),
    )
    within = F.col("v").between(F.col("new_lo"), F.col("new_hi"))
    bounds = proposed.select(*group, "new_lo", "new_hi")
    measured = long.join(bounds, same_keys(long, bounds, group)).select(
        *[long[k] for k in group], "v", "new_lo", "new_hi"
    ).groupBy(*group).agg(
        F.count_if(F.col("v") < F.col("new_lo")).alias("new_below"),
        F.count_if(within).alias("new_inside"),
        _sketch(F.when(within, F.col("v"))).alias("new_grid"),
        F.approx_count_distinct(F.when(within, F.col("v"))).alias("new_variety"),
    )
    both = proposed.join(measured, same_keys(proposed, measured, group))
    proven = (F.col("new_below") < first) & (
        F.col("new_below") + F.col("new_inside") >= second
    )
    kept = {
        "lo": "new_lo", "hi": "new_hi", "grid": "new_grid", "below": "new_below",
        "inside": "new_inside", "variety": "new_variety",
    }
    return materialize(
        both.select(
            *[proposed[k] for k in group],
            "n",
            *[
                F.when(proven, F.col(new)).otherwise(F.col(old)).alias(old)
                for old, new in kept.items()
            ],
        ),
        "median-brackets",
    )


def _pick(
    long: DataFrame,
    brackets: DataFrame,
    keys: list[str],
    measures: Sequence[str],
) -> DataFrame:
    group = [*keys, "measure"]
    first, second = _middle_ranks()
    bounds = brackets.select(*group, "lo", "hi", "below", first.alias("r1"), second.alias("r2"))
    counted = (
        long.join(bounds, same_keys(long, bounds, group))
        .where(F.col("v").between(F.col("lo"), F.col("hi")))
        .groupBy(*[long[k] for k in group], "v", "below", "r1", "r2")
        .agg(F.count(F.lit(1)).alias("c"))
    )
    order = Window.partitionBy(*group).orderBy("v")
    last = F.col("below") + F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, 0))
    ranked = counted.withColumn("last", last)

    def at(rank: str):
        holds = (F.col("last") - F.col("c") < F.col(rank)) & (F.col("last") >= F.col(rank))
        return F.max(F.when(holds, F.col("v")))

    medians = ranked.groupBy(*group).agg(((at("r1") + at("r2")) / 2).alias("median"))
    # Groups with nulls only have no median but keep their row.
    groups = brackets.select(*group)
    complete = groups.join(medians, same_keys(groups, medians, group), "left").select(
        *[groups[k] for k in group], "median"
    )
    # Pivot by hand: the measures are known, so no extra job looks for them.
    return complete.groupBy(*keys).agg(*[
        F.max(F.when(F.col("measure") == m, F.col("median"))).alias(m) for m in measures
    ])


def same_keys(left: DataFrame, right: DataFrame, names: Sequence[str]):
    """Null-safe equality on all of ``names`` (a null key is a group like any other)."""
    condition = F.lit(True)
    for name in names:
        condition = condition & left[name].eqNullSafe(right[name])
    return condition
