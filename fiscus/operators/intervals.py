"""Joins of points with the interval that holds them, for any type that can be ordered.

Intervals may overlap (the one with the smallest ``first`` counts), leave gaps, be open at either end
(null bound) and be as wide as they like. Of a key with few intervals each row meets them as one sorted
list and takes the first that holds its point; that is one join by the key.

Where a key has many, they are cut at all their ends into disjoint pieces; the
winner of a piece is the best of the nodes above it in a binary tree over the pieces, to which every
interval adds at most two nodes a level, so n intervals cost n log n rows however they overlap.
Points find the last piece that begins before them by one sorted pass over ranges.

Only the distinct points of a key take part in that pass; the rows themselves join them by equality,
where a hot point or key is an ordinary skewed join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fiscus.operators.ranks import last_seen, with_rank
from fiscus.session import materialize

#: A bound is (far, value, side): far is -1 or 1 for an open end; side tells a start (0), a point (1)
#: and what lies just after a value that still belongs to the interval (2) apart.
START, POINT, AFTER = 0, 1, 2
#: Intervals of a key that each of its rows is held against one by one.
FEW = 64


def _bound(far: Column | int, value: Column, side: int) -> Column:
    far = F.lit(far) if isinstance(far, int) else far
    return F.struct(far.alias("far"), value.alias("value"), F.lit(side).alias("side"))


def _nodes(start: str, end: str) -> Column:
    """Nodes (level, node) of a binary tree over ranks that together make up the ranks from start to before end."""
    return F.expr(f"""
        filter(flatten(transform(sequence(0, cast(floor(log2({end} - {start})) as int)), l -> array(
          if(shiftright({start} + shiftleft(1L, l) - 1, l) < shiftright({end}, l)
             and shiftright({start} + shiftleft(1L, l) - 1, l) % 2 = 1,
             named_struct('level', l, 'node', shiftright({start} + shiftleft(1L, l) - 1, l)), null),
          if(shiftright({start} + shiftleft(1L, l) - 1, l) < shiftright({end}, l)
             and shiftright({end}, l) % 2 = 1,
             named_struct('level', l, 'node', shiftright({end}, l) - 1), null)))), x -> x is not null)""")


def disjoint_pieces(
    intervals: DataFrame, low: str, high: str, first: str, payload: Sequence[str],
    keys: Sequence[str] = (), closed: bool = True,
) -> DataFrame:
    """(keys, at, found) for each piece: where it begins, and the payload that counts there; null in a gap.

    ``closed``: the upper bound still belongs to the interval. Among intervals with equal ``first``
    the one with the smallest payload counts. An interval that ends before it begins holds nothing.
    """
    keys = list(keys)
    ends = intervals.where(F.col(low).isNull() | F.col(high).isNull() | (
        F.col(low) <= F.col(high) if closed else F.col(low) < F.col(high)
    )).dropna(subset=keys or None, how="any" if keys else "all")
    kind = intervals.schema[low].dataType
    ends = materialize(ends.select(
        *keys,
        _bound(F.when(F.col(low).isNull(), -1).otherwise(0), F.col(low), START).alias("a"),
        _bound(F.when(F.col(high).isNull(), 1).otherwise(0), F.col(high).cast(kind), AFTER if closed else START).alias("b"),
        F.struct(F.col(first).alias("first"), F.struct(*payload).alias("payload")).alias("bid"),
    ), "intervals")
    cuts = ends.select(*keys, F.explode(F.array("a", "b")).alias("at")).distinct()
    ranked = materialize(with_rank(cuts, [*[F.col(k) for k in keys], F.col("at")]), "cuts")

    def ranks(name: str) -> DataFrame:
        return ranked.select(*keys, F.col("at").alias(name), F.col("rank").alias(f"{name}_rank"))

    spans = ends.join(ranks("a"), [*keys, "a"]).join(ranks("b"), [*keys, "b"])
    best = materialize(
        spans.select("bid", F.inline(_nodes("a_rank", "b_rank")).alias("level", "node"))
        .groupBy("level", "node").agg(F.min("bid").alias("bid")), "nodes",
    )
    # At most one number for each doubling of the pieces.
    levels = best.agg(F.max("level").alias("top"))
    above = ranked.select("rank", F.explode(F.sequence(F.lit(0), F.coalesce(levels.scalar(), F.lit(0)))).alias("level"))
    above = above.withColumn("node", F.expr("shiftright(rank, level)"))
    won = above.join(best, ["level", "node"]).groupBy("rank").agg(F.min("bid").getField("payload").alias("found"))
    return ranked.join(won, "rank", "left").select(*keys, "at", "found")


def with_interval(
    df: DataFrame, intervals: DataFrame, point: str, low: str, high: str, first: str,
    payload: Sequence[str], keys: Sequence[str] = (), closed: bool = True, few: int = FEW,
) -> DataFrame:
    """``df`` with the payload of the interval that holds ``point``, nulls where none does.

    ``keys``: columns that row and interval must share; a null key or point is in no interval.
    ``few``: intervals of a key up to which they are tried one by one.
    """
    keys, kind = list(keys), df.schema[point].dataType
    bounds = intervals.withColumns({low: F.col(low).cast(kind), high: F.col(high).cast(kind)})
    told = (point, low, high, first, payload, keys, closed)
    if not keys:
        return _by_list(df, bounds, *told) if bounds.limit(few + 1).count() <= few else _by_pieces(df, bounds, *told)
    bounds = bounds.dropna(subset=keys)
    many = bounds.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > few).select(*keys)
    many = materialize(many, "many-intervals")
    if many.isEmpty():
        return _by_list(df, bounds, *told)
    return _by_list(
        df.join(many, keys, "left_anti"), bounds.join(many, keys, "left_anti"), *told
    ).unionByName(_by_pieces(df.join(many, keys, "left_semi"), bounds.join(many, keys, "left_semi"), *told))


def _by_list(
    df: DataFrame, bounds: DataFrame, point: str, low: str, high: str, first: str,
    payload: Sequence[str], keys: list[str], closed: bool,
) -> DataFrame:
    """``with_interval`` by trying the intervals of a key in their order."""
    bid = F.struct(
        F.col(first).alias("first"), F.struct(*payload).alias("payload"), F.col(low).alias("low"), F.col(high).alias("high")
    )
    lists = bounds.groupBy(*keys).agg(F.sort_array(F.collect_list(bid)).alias("bids"))
    # Stored, so that whether it is broadcast follows from its measured size.
    lists = materialize(lists, "intervals")
    met = df.join(lists, keys, "left") if keys else df.withColumn("bids", lists.scalar())

    def holds(b: Column) -> Column:
        x = F.col(point)
        until = x <= b["high"] if closed else x < b["high"]
        # Two open ends hold every point, but one that is null is in no interval.
        return x.isNotNull() & (b["low"].isNull() | (b["low"] <= x)) & (b["high"].isNull() | until)

    found = F.get(F.filter("bids", holds), F.lit(0))["payload"]
    own = [point, *[c for c in df.columns if c != point and c not in keys]]
    return met.select(*keys, *own, found.alias("found")).select(*keys, *own, *[F.col(f"found.{p}").alias(p) for p in payload])


def _by_pieces(
    df: DataFrame, bounds: DataFrame, point: str, low: str, high: str, first: str,
    payload: Sequence[str], keys: list[str], closed: bool,
) -> DataFrame:
    """``with_interval`` by disjoint pieces and one sorted pass, for any number of intervals."""
    pieces = disjoint_pieces(bounds, low, high, first, payload, keys, closed)
    points = df.select(*keys, F.col(point)).dropna().distinct().select(
        *keys, _bound(0, F.col(point), POINT).alias("at"), F.lit(None).cast(pieces.schema["found"].dataType).alias("found"),
        F.lit(True).alias("is_point"),
    )
    begun = pieces.withColumn("is_point", F.lit(False)).unionByName(points)
    # A gap is a piece too: it ends the one before.
    told = F.when(~F.col("is_point"), F.struct("found")).alias("piece")
    seen = last_seen(begun.select(*keys, "at", told, "is_point"), keys, "at", "piece")
    found = seen.where("is_point and piece.found is not null").select(
        *keys, F.col("at.value").alias(point), *[F.col(f"piece.found.{p}").alias(p) for p in payload]
    )
    # Stored, so that whether it is broadcast follows from its measured size.
    return df.join(materialize(found, "points"), [*keys, point], "left")
