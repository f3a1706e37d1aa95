"""Exact top-k search by inner product with KD-trees per shard.

Rows are dealt to shards of bounded size; each shard is a KD-tree built by median splits, every
node with the tight bounding box of its rows. A query walks a tree best-first: the node whose box
allows the largest product comes next, and the walk ends where no box can beat the k-th score
found so far. Blocks of queries first search one shard each; the k-th scores found there go with
the queries to all other shards, so that most of their nodes are never opened.

Components are the integers floor(scale * x), products are exact (64-bit). Ties go to the smaller
id; a box that could only tie is opened only if it holds a smaller id. Vectors that are null or
hold null or non-finite components, and rows without an id, take no part; vectors of different
lengths are not compared. A query with fewer candidates than k gets all. Repeated rows are rows of
their own; a query never meets rows with its own id.
"""

from __future__ import annotations

import heapq
import io
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fiscus.llm.common import collected, record, stored
from fiscus.llm.vectors import matrices

K, SCALE = 20, 64
SHARD, LEAF, BLOCK = 16_384, 512, 1024
NO_ID = 2**63 - 1


def _pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _unpack(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as found:
        return {k: found[k] for k in found.files}


def _narrow(points: np.ndarray) -> np.ndarray:
    """The smallest integer type that holds the points."""
    most = int(np.abs(points).max(initial=0))
    return points.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64)


def build(ids: np.ndarray, points: np.ndarray, leaf: int = LEAF) -> dict[str, np.ndarray]:
    """A KD-tree: rows in leaf order; per node its rows, children (-1: leaf), box and smallest id."""
    order = np.argsort(ids, kind="stable")
    ids, points = ids[order], points[order]
    rows = np.arange(len(ids))
    begin, end, left, low, high, least = [], [], [], [], [], []

    def node(a: int, b: int) -> int:
        some = points[rows[a:b]]
        begin.append(a)
        end.append(b)
        left.append(-1)
        low.append(some.min(axis=0))
        high.append(some.max(axis=0))
        least.append(ids[rows[a:b]].min())
        return len(begin) - 1

    todo = [node(0, len(ids))] if len(ids) else []
    while todo:
        n = todo.pop()
        a, b = begin[n], end[n]
        if b - a <= leaf:
            continue
        spread = high[n] - low[n]
        middle = (b - a) // 2
        if spread.max(initial=0):  # equal rows stay in the order of their ids
            values = points[rows[a:b], spread.argmax()]
            rows[a:b] = rows[a:b][np.argsort(values, kind="stable")]
        left[n] = node(a, a + middle)
        todo += [left[n], node(a + middle, b)]
    return {
        "ids": ids[rows], "points": _narrow(points[rows]), "begin": np.array(begin), "end": np.array(end), "left": np.array(left),
        "low": _narrow(np.array(low)), "high": _narrow(np.array(high)), "least": np.array(least),
    }


class Tree:
    def __init__(self, data: bytes):
        self.__dict__ |= _unpack(data)
        self.most = max(float(np.abs(x.astype(float)).max(initial=0)) for x in (self.low, self.high))
        self.dim = self.points.shape[1]
        self.as_float = self.points.astype(np.float64)

    def small(self, queries: np.ndarray) -> bool:
        """Whether floating point holds every sum of products exactly."""
        return self.most * np.abs(queries).max(initial=0) * max(self.dim, 1) < 2**52

    def products(self, rows: slice, queries: np.ndarray) -> np.ndarray:
        """Exact integer products."""
        if self.small(queries):
            return (self.as_float[rows] @ queries.T.astype(np.float64)).astype(np.int64)
        return self.points[rows].astype(np.int64) @ queries.T

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Largest product that each node's box allows each query; rounded up where floating point is not exact."""
        up, down = np.maximum(queries, 0).astype(float), np.minimum(queries, 0).astype(float)
        found = up @ self.high.T.astype(float) + down @ self.low.T.astype(float)
        return found if self.small(queries) else found + np.abs(found) * 1e-12 + 1

    def search(self, query_ids: np.ndarray, queries: np.ndarray, kth: np.ndarray, k: int):
        """(query, id, score) arrays: all rows that can be among a query's k best, given that k rows reach kth elsewhere."""
        bounds = self.bounds(queries)
        points, asked = (self.as_float, queries.astype(np.float64)) if self.small(queries) else (self.points.astype(np.int64), queries)
        out = []
        for q, own in enumerate(query_ids):
            bound, known = bounds[q], kth[q]
            scores, ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
            limit, limit_id = known, NO_ID
            heap = [(-bound[0], 0)]
            while heap:
                top, n = heapq.heappop(heap)
                if -top < limit:
                    break
                if -top == limit and self.least[n] > limit_id:
                    continue
                child = self.left[n]
                if child >= 0:
                    for c in (int(child), int(child) + 1):  # siblings are made one after the other
                        if bound[c] >= limit:
                            heapq.heappush(heap, (-bound[c], c))
                    continue
                rows = slice(self.begin[n], self.end[n])
                score = points[rows] @ asked[q]
                fine = np.flatnonzero(score >= limit)
                fine = fine[self.ids[rows][fine] != own]
                if not len(fine):
                    continue
                scores = np.concatenate([scores, score[fine].astype(np.int64)])
                ids = np.concatenate([ids, self.ids[rows][fine]])
                if len(scores) >= k:
                    best = np.lexsort((ids, -scores))[:k]
                    scores, ids = scores[best], ids[best]
                    if scores[-1] >= known:
                        limit, limit_id = scores[-1], ids[-1]
            out.append((np.full(len(ids), own), ids, scores))
        return [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3


def top_k(df: DataFrame, query_every: int, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, scale: int = SCALE, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each row whose id is divisible by ``query_every``."""
    spark = df.sparkSession

    def integers(batches):
        for batch in batches:
            for rows, values in matrices(batch.column(1)):
                grid = np.floor(values * scale)
                if np.abs(grid).max(initial=0) >= 1 << 28:
                    raise ValueError("a component is too large for exact 64-bit products")
                packed = grid.astype("<i4")
                yield record(["vec_id", "dim", "point"], [
                    batch.column(0).take(pa.array(rows)), np.full(len(rows), values.shape[1], np.int32),
                    pa.array([x.tobytes() for x in packed], pa.binary()),
                ])

    points = stored(
        df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector")).where("vec_id IS NOT NULL")
        .mapInArrow(integers, "vec_id long, dim int, point binary"), "points",
    )
    asked = points.where(F.col("vec_id") % query_every == 0)

    def dealt(rows: DataFrame, each: int) -> tuple[DataFrame, DataFrame]:
        """Rows with a part of their length's parts, ``each`` rows in one on average; and the parts of each length."""
        parts = stored(rows.groupBy("dim").agg(F.ceil(F.count("*") / each).cast("int").alias("parts")), "parts")
        # The place of the row spreads repeated ids.
        return rows.withColumn("seed", F.monotonically_increasing_id()).join(parts, "dim").withColumn(
            "part", F.pmod(F.xxhash64("vec_id", "seed"), F.col("parts")).cast("int")).select("dim", "part", "vec_id", "point"), parts

    def grouped(batches, make):
        rows = collected(batches)
        if rows is None:
            return
        dim, part = rows.column(0).to_numpy(), rows.column(1).to_numpy()
        ids = rows.column(2).to_numpy()
        for d, p in sorted(set(zip(dim.tolist(), part.tolist(), strict=True))):
            some = np.flatnonzero((dim == d) & (part == p))
            data = b"".join(rows.column(3).take(pa.array(some)).to_pylist())
            grid = np.frombuffer(data, "<i4").reshape(len(some), d).astype(np.int64)
            yield record(["dim", "part", "data"], [pa.array([d], pa.int32()), pa.array([p], pa.int32()), pa.array([make(ids[some], grid)], pa.binary())])

    shards, shard_parts = dealt(points, shard)
    blocks, block_parts = dealt(asked, block)
    many = lambda parts: max(parts.agg(F.sum("parts")).first()[0] or 1, 1)
    n_shards, n_blocks = many(shard_parts), many(block_parts)
    trees = stored(
        shards.repartition(n_shards, "dim", "part").mapInArrow(lambda b: grouped(b, lambda i, g: _pack(**build(i, g))), "dim int, part int, data binary"), "trees"
    ).withColumnRenamed("part", "shard").withColumnRenamed("data", "tree")
    packed = stored(
        blocks.repartition(n_blocks, "dim", "part").mapInArrow(lambda b: grouped(b, lambda i, g: _pack(ids=i, points=_narrow(g))), "dim int, part int, data binary"), "query-blocks"
    ).withColumnRenamed("part", "block").join(shard_parts, "dim")

    def visits(rows: DataFrame, label: str, home: bool) -> DataFrame:
        def run(batches):
            kept = (None, None)
            for batch in batches:
                for dim, at, block_no, tree, queries, before in zip(*[batch.column(i).to_pylist() for i in range(6)], strict=True):
                    if kept[0] != (dim, at):
                        kept = ((dim, at), Tree(tree))
                    asked_now = _unpack(queries)
                    kth = _unpack(before)["kth"] if before else np.full(len(asked_now["ids"]), -(2**62))
                    query, ids, score = kept[1].search(asked_now["ids"], asked_now["points"].astype(np.int64), kth, k)
                    done = b""
                    if home:  # the k-th score of each query that found k rows
                        done = np.full(len(asked_now["ids"]), -(2**62))
                        row = {int(x): i for i, x in enumerate(asked_now["ids"])}
                        cuts = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else np.zeros(0, np.int64)
                        for a, b in zip(cuts, [*cuts[1:], len(query)], strict=True):
                            if b - a >= k:
                                done[row[int(query[a])]] = score[a:b].min()
                        same = np.array([row[int(x)] for x in asked_now["ids"]], np.int64)
                        done = _pack(kth=done[same] if len(same) else done)
                    yield record(["dim", "block", "kth", "query_id", "vec_id", "score"], [
                        pa.array([dim], pa.int32()), pa.array([block_no], pa.int32()), pa.array([done], pa.binary()),
                        *[pa.array([x.tolist()], pa.list_(pa.int64())) for x in (query, ids, score)],
                    ])

        count = max(n_shards, min(n_shards * n_blocks, 4 * spark.sparkContext.defaultParallelism))
        spread = rows.repartition(count, "dim", "shard", "block").sortWithinPartitions("dim", "shard")
        return stored(spread.mapInArrow(run, "dim int, block int, kth binary, query_id array<long>, vec_id array<long>, score array<long>"), label)

    first = packed.withColumn("shard", F.expr("cast(pmod(block, parts) as int)"))
    columns = ["dim", "shard", "block", "tree", "data"]
    near = visits(first.join(trees, ["dim", "shard"]).select(*columns, F.lit(None).cast("binary").alias("kth")), "home-visits", True)
    rest = (
        packed.join(near.select("dim", "block", "kth"), ["dim", "block"])
        .withColumn("shard", F.explode(F.expr("filter(sequence(0, parts - 1), s -> s != pmod(block, parts))")))
    )
    far = visits(rest.join(trees, ["dim", "shard"]).select(*columns, "kth"), "other-visits", False)
    each = near.drop("kth").union(far.drop("kth")).select(F.explode(F.arrays_zip("query_id", "vec_id", "score")).alias("x")).select("x.*")
    # At most k rows from each shard for each query.
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
