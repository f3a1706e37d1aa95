"""Near-duplicate vectors by Euclidean p-stable hashing.

Equal vectors with equal labels are one class. In each of several tables a class is filed under
its label and the quantised random projections of its normalised vector; classes that share a
file are compared exactly by cosine in double precision. A pair that meets in several tables
counts in the first. Files with many classes are cut into blocks that meet pair by pair; tasks
pass on counts and connecting links, never pairs.

For vectors at the threshold of 0.98 (distance 0.2) one projection agrees with probability
``1 - 2/(w/c) / sqrt(2 pi)`` or about 0.87 at width 1.2, eight of them with 0.32, and one of
twelve tables finds the pair with 0.99.

Vectors that are null, empty, zero or hold null or non-finite components, and rows without a label
or an id, link with nothing: no links, their own id, kept. Vectors of different lengths are not
compared. Repeated rows are rows of one class. Labels may be of any type that can be compared and
are equal as Spark has them equal. Components are scaled by a power of two, which changes no cosine,
so that squares of very large and very small ones neither over- nor underflow.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from fiscus.llm.common import binaries, collected, mix, partitions, ranges, record, stored
from fiscus.llm.components import components, forest
from fiscus.llm.vectors import matrices

COSINE, WIDTH, PROJECTIONS, TABLES, SEED = 0.98, 1.2, 8, 12, 7
#: Classes in one block of a file, rows of one task, pairs compared at once.
BLOCK, ROWS, PAIRS = 1024, 20_000, 100_000


def table_keys(vectors: np.ndarray, labels: np.ndarray, width: float = WIDTH, projections: int = PROJECTIONS, tables: int = TABLES, seed: int = SEED) -> np.ndarray:
    """One 64-bit key for each vector and table."""
    dim = vectors.shape[1]
    rng = np.random.default_rng([seed, dim])
    lines, shifts = rng.standard_normal((dim, tables * projections)), rng.uniform(0, width, tables * projections)
    unit = vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]
    cells = np.floor((unit @ lines + shifts) / width).astype(np.int64).view(np.uint64).reshape(len(vectors), tables, projections)
    keys = mix(np.arange(1, tables + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :] ^ mix(labels.astype(np.int64).view(np.uint64) + np.uint64(dim << 32))[:, None]
    for i in range(projections):
        keys = mix(keys ^ (cells[:, :, i] + np.uint64(0x9E3779B97F4A7C15)))
    return keys.view(np.int64)


def scaled(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are not zero, and these with their largest component brought between a half and one."""
    if not values.shape[1]:
        return np.zeros(len(values), bool), values[:0]
    most = np.abs(values).max(axis=1)
    fine = most > 0
    return fine, np.ldexp(values[fine], -np.frexp(most[fine])[1][:, None]) + 0.0  # one kind of zero


def numbered(rows: DataFrame) -> DataFrame:
    """Labels as long numbers, equal where the labels are: whole numbers as they are, others by a table of them."""
    if isinstance(rows.schema["label"].dataType, (ByteType, ShortType, IntegerType, LongType)):
        return rows.withColumn("label", F.col("label").cast("long"))
    known = stored(
        rows.where("label IS NOT NULL").select("label").distinct().withColumn("number", F.monotonically_increasing_id()), "labels"
    )
    return rows.join(known, "label", "left").select("vec_id", "vector", F.col("number").alias("label"))


def _compare(table_no, key, cell, cells, block, ids, sizes, keys, vectors, cosine: float):
    """Counts (row, links) and links (row, row) among the rows of one task, each pair of rows of a cell once."""
    order = np.lexsort((cell, key))
    heads = np.flatnonzero(np.concatenate([[True], (key[order][1:] != key[order][:-1]) | (cell[order][1:] != cell[order][:-1])]))
    ends = np.append(heads[1:], len(order))
    norm = np.sqrt((vectors * vectors).sum(axis=1))
    count, links_a, links_b = np.zeros(len(ids), np.int64), [], []

    def met(i, j):
        """Pairs of rows whose first common table is this one and whose blocks meet in this cell."""
        a, b = block[i], block[j]
        wide, c = cells[i], cell[i]
        here = (wide == 1) | (np.minimum(a, b) * wide + np.maximum(a, b) == c)
        same = keys[i] == keys[j]
        return here & (same.argmax(axis=1) == table_no[i])

    def found(i, j):
        fine = met(i, j)
        i, j = i[fine], j[fine]
        near = np.einsum("ij,ij->i", vectors[i], vectors[j]) / (norm[i] * norm[j]) >= cosine
        i, j = i[near], j[near]
        np.add.at(count, i, sizes[j])
        np.add.at(count, j, sizes[i])
        if len(i):
            a, b = forest(i, j)
            links_a.append(a)
            links_b.append(b)

    span = ends - heads
    small = (span > 1) & (span <= 48)
    # Small files: all pairs (i < j) of all files, a bounded number at once.
    place = np.concatenate([np.arange(a, b) for a, b in zip(heads[small], ends[small], strict=True)] or [np.zeros(0, np.int64)])
    last = np.repeat(ends[small], span[small])
    todo = last - place - 1
    for part in np.split(np.arange(len(place)), np.flatnonzero(np.diff(np.cumsum(todo) // PAIRS)) + 1):
        if len(part):
            found(order[np.repeat(place[part], todo[part])], order[ranges(place[part] + 1, todo[part])])
    for a, b in zip(heads[span > 48], ends[span > 48], strict=True):
        rows = order[a:b]
        for s in range(0, len(rows), 256):
            some = rows[s:s + 256]
            near = (vectors[some] @ vectors[rows].T) / (norm[some][:, None] * norm[rows][None, :]) >= cosine - 1e-9
            i, j = np.nonzero(near)
            later = j > i + s
            i, j = some[i[later]], rows[j[later]]
            for x in range(0, len(i), PAIRS):
                found(i[x:x + PAIRS], j[x:x + PAIRS])
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (links_a, links_b))
    return count, ids[a], ids[b]


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    spark = df.sparkSession
    rows = numbered(df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"), F.col(label_col).alias("label")))

    def usable(batches):
        for batch in batches:
            for some, values in matrices(batch.column(1)):
                fine, values = scaled(values)
                if fine.any():
                    some, values = some[fine], np.ascontiguousarray(values)
                    pick = pa.array(some)
                    digest = np.array([xxhash.xxh3_128_intdigest(x.tobytes()) & ((1 << 126) - 1) for x in values], object)
                    yield record(["vec_id", "label", "d1", "d2", "vector"], [
                        batch.column(0).take(pick), batch.column(2).take(pick),
                        pa.array([int(x >> 63) for x in digest], pa.int64()), pa.array([int(x & ((1 << 63) - 1)) for x in digest], pa.int64()),
                        binaries(values.reshape(-1), np.arange(len(values) + 1) * values.shape[1]),
                    ])

    told = stored(rows.where("vec_id IS NOT NULL AND label IS NOT NULL").mapInArrow(usable, "vec_id long, label long, d1 long, d2 long, vector binary"), "vectors")
    classes = told.groupBy("label", "d1", "d2", "vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size"))

    def filed(batches):
        for batch in batches:
            widths = pa.compute.binary_length(batch.column(3)).to_numpy()
            for width in np.unique(widths):
                pick = np.flatnonzero(widths == width)
                part = batch.take(pa.array(pick))
                values = np.frombuffer(b"".join(part.column(3).to_pylist()), np.float64).reshape(len(pick), -1)
                keys = table_keys(values, part.column(0).to_numpy())
                lists = pa.ListArray.from_arrays(pa.array((np.arange(len(pick) + 1) * keys.shape[1]).astype(np.int32)), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=["label", "d1", "d2", "vector", "rep", "size", "keys"])

    entries = stored(classes.mapInArrow(filed, "label long, d1 long, d2 long, vector binary, rep long, size long, keys array<long>"), "classes")
    place = entries.select("d1", "d2", "label", F.posexplode("keys").alias("table_no", "key"))
    shared = stored(
        place.groupBy("key").count().where("count > 1").select("key", F.ceil(F.col("count") / block).cast("int").alias("cells")), "shared-files"
    )
    member = place.join(shared, "key").groupBy("label", "d1", "d2").agg(F.collect_list(F.struct("table_no", "key", "cells")).alias("files"))
    cut = F.expr("cast(pmod(xxhash64(d1, d2), cells) as int)")
    out = (
        entries.join(member, ["label", "d1", "d2"]).withColumn("file", F.explode("files"))
        .select("d1", "d2", "rep", "size", "keys", "vector", "file.*").withColumn("block", cut)
        .withColumn("cell", F.explode(F.expr("transform(sequence(0, cells - 1), x -> least(x, block) * cells + greatest(x, block))")))
        .select("table_no", "key", "cell", "cells", "block", "rep", "size", "keys", "vector")
    )
    total = place.join(shared, "key").agg(F.sum("cells")).first()[0] or 0

    def compare(batches):
        got = collected(batches)
        if got is None:
            return
        columns = [got.column(i).to_numpy() for i in range(7)]
        keys = got.column(7).combine_chunks()
        widths = np.array([len(x) for x in got.column(8).to_pylist()])
        grid = keys.values.to_numpy().reshape(got.num_rows, -1)
        data = got.column(8).to_pylist()
        for width in np.unique(widths):
            pick = np.flatnonzero(widths == width)
            values = np.frombuffer(b"".join([data[i] for i in pick]), np.float64).reshape(len(pick), -1)
            count, a, b = _compare(*[x[pick] for x in columns[:5]], columns[5][pick], columns[6][pick], grid[pick], values, cosine)
            some = count > 0
            ids, at = np.unique(columns[5][pick][some], return_inverse=True)
            sums = np.bincount(at, count[some], len(ids)).astype(np.int64)
            yield record(["rep", "links", "other"], [np.concatenate([ids, a]), np.concatenate([sums, np.zeros(len(a), np.int64)]), pa.array(np.concatenate([ids, b]))])

    found = stored(
        out.repartition(partitions(spark, total, ROWS), "key", "cell").mapInArrow(compare, "rep long, links long, other long"), "links"
    )
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(found.where("rep != other").select("rep", "other")).toDF("rep", "root")
    solved = stored(
        entries.select("label", "d1", "d2", "rep", "size").join(counts, "rep", "left").join(roots, "rep", "left")
        .select("label", "d1", "d2", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id")),
        "solved",
    )
    linked = told.select("vec_id", "label", "d1", "d2").join(solved, ["label", "d1", "d2"]).select("vec_id", "n_links", "component_id")

    def unusable(batches):
        for batch in batches:
            bad = np.ones(batch.num_rows, bool)
            for some, values in matrices(batch.column(1)):
                bad[some[scaled(values)[0]]] = False
            bad |= batch.column(0).is_null().to_numpy(zero_copy_only=False) | batch.column(2).is_null().to_numpy(zero_copy_only=False)
            yield record(["vec_id"], [batch.column(0).filter(pa.array(bad))])

    alone = rows.mapInArrow(unusable, "vec_id long").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
