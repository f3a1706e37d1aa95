"""Hard negatives by angular triangle filtering.

Every vector stores its norm and its angles to a few reference directions. By the triangle inequality
on the sphere the angle of two vectors lies between the difference of their angles to a reference and
the lesser of their sum and what it lacks of a full turn; the tightest of these intervals, as cosines,
times the norms and widened by more than rounding can make up, bounds the integer score. Only rows
whose bounds reach into a window that is still asked for are scored, in integers.

Vectors are filed under the reference they are closest to, and files are cut into shards of at most
about ``SHARD`` rows. Anchors visit shards in three rounds: the shards of their own file for a first set of
positives, then those of every file whose angles allow a better positive, then those of every file
whose angles allow a score in one of the negatives' windows. A shard's rows are in one task, in blocks
of like angles whose bounds are tried first; anchors are streamed past them, ``VISITORS`` at most to a copy
of the shard, and leave with the best of the shard alone.

A component x counts as floor(scale * x). Rows with a null label, a null vector or a null or non-finite
component take no part, nor do rows with a null id; a row's label is first changed where its id is
divisible by ``shifted``. Vectors of different lengths have no score. Ties go to the smaller id; rows
that repeat an id are rows of their own, but no row that has the anchor's id is its positive, and an
anchor whose id repeats mines once for each of its different vectors. Scores are exact up to 38 digits;
one that does not fit 64 bits is returned as the nearest number that does. An empty table mines nothing.
"""

from __future__ import annotations

import decimal
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fiscus.llm.common import binaries, partitions, record, stored
from fiscus.llm.vectors import matrices

SCALE, EVERY, SHIFTED, LABELS = 256, 50, 7, 10
POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95
#: References of each length of vectors, and the rows they are learned from (those with the smallest hashes).
REFERENCES, SAMPLE = 24, 4096
SHARD, VISITORS, BLOCK, GROUP = 32_768, 65_536, 256, 64
#: References whose angles bound single rows: those the anchor is closest to, or farthest from.
CLOSE = 6
#: Squares of norms from here on leave doubles' exact integers; such rows have files of their own and are scored in Python's integers.
EXACT = 2.0**52
#: Files of a length of vectors: one for each reference, and as many for large vectors.
FILES, LARGE = 64, 32
SLACK = 1e-6
ROW = "vec_id long, label long, file int, norm double, angles binary, vector binary"


def large(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Whether inner products of the integer vectors could leave the doubles' exact integers."""
    with np.errstate(over="ignore"):
        scaled = np.floor(vectors * scale)
        return ~((scaled * scaled).sum(axis=1) < EXACT)


def integers(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x): as doubles where these are exact, else as Python's integers."""
    if not large(vectors, scale).any():
        return np.floor(vectors * scale)
    exact = [[math.floor(x) * scale + math.floor((x - math.floor(x)) * scale) for x in row] for row in vectors.tolist()]
    return np.array(exact, object).reshape(vectors.shape)


def references(vectors: np.ndarray, count: int = REFERENCES, rounds: int = 4) -> np.ndarray:
    """Unit directions among the vectors: each next one is the vector farthest from those before, then means of the closest."""
    unit = vectors / np.maximum(np.sqrt((vectors * vectors).sum(axis=1)), 1e-300)[:, None]
    chosen = [0]
    near = unit @ unit[0]
    for _ in range(min(count, len(unit)) - 1):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, unit @ unit[chosen[-1]])
    centre = unit[chosen]
    for _ in range(rounds):
        own = (unit @ centre.T).argmax(axis=1)
        for i in range(len(centre)):
            mean = unit[own == i].sum(axis=0)
            size = math.sqrt(float(mean @ mean))
            if size > 1e-9:
                centre[i] = mean / size
    return centre


def angles_to(values: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms of integer vectors and their angles to the references; a zero vector has right angles."""
    top = np.abs(values).max(axis=1, initial=0)
    unit = (values / np.where(top > 0, top, 1)[:, None]).astype(np.float64)
    size = np.sqrt((unit * unit).sum(axis=1))
    unit /= np.where(size > 0, size, 1)[:, None]
    return size * top.astype(np.float64), np.arccos(np.clip(unit @ centre.T, -1, 1))


def bounds(norm_a, angles_a, norm_low, norm_high, angles_low, angles_high):
    """Lowest and highest scores of anchors (rows) with blocks (columns) whose angles and norms are within ranges."""
    between = np.maximum(angles_low[None, :, :] - angles_a[:, None, :], angles_a[:, None, :] - angles_high[None, :, :]).max(axis=2)
    least = np.clip(between - SLACK, 0, np.pi)
    most = np.minimum(angles_a[:, None, :] + angles_high[None, :, :], 2 * np.pi - angles_a[:, None, :] - angles_low[None, :, :]).min(axis=2)
    most = np.clip(most + SLACK, 0, np.pi)
    high, low = np.cos(least), np.cos(most)
    up = norm_a[:, None] * np.where(high >= 0, norm_high, norm_low) * high
    down = norm_a[:, None] * np.where(low >= 0, norm_low, norm_high) * low
    spare = 1 + 1e-9 * norm_a[:, None] * norm_high
    return down - spare, up + spare


class Shard:
    """The rows of a shard in blocks of like angles."""

    def __init__(self, table: pa.Table, scale: int):
        self.ids, self.labels = table.column(0).to_numpy(), table.column(1).to_numpy()
        angles = np.frombuffer(b"".join(table.column(4).to_pylist()), np.float64).reshape(len(self.ids), -1)
        vectors = np.frombuffer(b"".join(table.column(5).to_pylist()), np.float64).reshape(len(self.ids), -1)
        order = np.lexsort((angles[:, angles.var(axis=0).argmax()], self.labels))
        self.ids, self.labels, self.vectors = self.ids[order], self.labels[order], integers(vectors[order], scale)
        self.norm, self.angles = table.column(3).to_numpy()[order], angles[order]
        # No block holds two labels.
        change = np.flatnonzero(np.concatenate([[True], self.labels[1:] != self.labels[:-1]]))
        ends = np.append(change[1:], len(self.ids))
        self.cuts = np.concatenate([np.arange(a, b, BLOCK) for a, b in zip(change, ends, strict=True)])
        self.ends = np.append(self.cuts[1:], len(self.ids))
        self.label = self.labels[self.cuts]
        self.ranges = [
            np.minimum.reduceat(self.norm, self.cuts), np.maximum.reduceat(self.norm, self.cuts),
            np.minimum.reduceat(self.angles, self.cuts, axis=0), np.maximum.reduceat(self.angles, self.cuts, axis=0),
        ]

    def scores(self, vector: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Integer scores of some rows: 64-bit where they fit, else Python's integers."""
        own = self.vectors[rows]
        if vector.dtype != object and own.dtype != object:
            return (own @ vector).astype(np.int64)
        whole = own if own.dtype == object else own.astype(np.int64).astype(object)
        return whole @ np.array([int(x) for x in vector], object)

    def open_rows(self, norm: float, angles: np.ndarray, blocks: np.ndarray, low: float, high: float) -> np.ndarray:
        """Rows of some blocks whose own bounds meet the window from low to high."""
        rows = np.concatenate([np.arange(self.cuts[b], self.ends[b]) for b in blocks]) if len(blocks) else np.zeros(0, np.int64)
        if not len(rows):
            return rows
        close = np.argsort(-np.abs(angles - np.pi / 2))[:CLOSE]
        own = self.angles[rows][:, close]
        down, up = bounds(np.array([norm]), angles[None, close], self.norm[rows], self.norm[rows], own, own)
        return rows[(up[0] >= low) & (down[0] <= high)]

    def positives(self, own_id: int, label: int, norm: float, angles: np.ndarray, vector: np.ndarray, down, up, floor: int, count: int):
        """The best ``count`` other rows of the label with at least the score ``floor``: (score, id) from the best down."""
        blocks = np.flatnonzero((self.label == label) & (up >= floor))
        blocks = blocks[np.argsort(-up[blocks], kind="stable")]
        found: list[tuple[int, int]] = []
        for i in range(0, len(blocks), 4):
            some = blocks[i:i + 4]
            if up[some[0]] < floor:
                break
            rows = self.open_rows(norm, angles, some, floor, math.inf)
            rows = rows[self.ids[rows] != own_id]
            if len(rows):
                score = self.scores(vector, rows)
                found = best([*found, *zip(score.tolist(), self.ids[rows].tolist(), strict=True)], count)
                if len(found) == count:
                    floor = max(floor, found[-1][0])
        return [x for x in found if x[0] >= floor]

    def negatives(self, label: int, norm: float, angles: np.ndarray, vector: np.ndarray, down, up, windows: list[tuple[int, int]], count: int):
        """For each window of scores, the best ``count`` rows of other labels within it: (window, score, id)."""
        some = [w for w in windows if w[0] <= w[1]]
        if not some:
            return []
        low, high = min(w[0] for w in some), max(w[1] for w in some)
        blocks = np.flatnonzero((self.label != label) & (up >= low) & (down <= high))
        blocks = blocks[np.argsort(-up[blocks], kind="stable")]
        found: list[list[tuple[int, int]]] = [[] for _ in windows]
        for i in range(0, len(blocks), 8):
            # A full window asks for its last score and above only.
            low = min(f[-1][0] if len(f) == count else w[0] for w, f in zip(windows, found, strict=True) if w[0] <= w[1])
            if up[blocks[i]] < low:
                break
            rows = self.open_rows(norm, angles, blocks[i:i + 8], low, high)
            if not len(rows):
                continue
            score = self.scores(vector, rows)
            for k, (a, b) in enumerate(windows):
                inside = np.flatnonzero((score >= a) & (score <= b))
                if len(inside):
                    found[k] = best([*found[k], *zip(score[inside].tolist(), self.ids[rows[inside]].tolist(), strict=True)], count)
        return [(k, s, i) for k, f in enumerate(found) for s, i in f]


def best(pairs: list[tuple[int, int]], count: int) -> list[tuple[int, int]]:
    """The highest scores, ties to the smaller id."""
    return sorted(pairs, key=lambda x: (-x[0], x[1]))[:count]


def exactly(score: int) -> decimal.Decimal:
    """A score for a column of 38 digits; what has more counts as the largest."""
    return decimal.Decimal(max(1 - 10**38, min(10**38 - 1, int(score))))


def window_of(score: int, low: int, high: int) -> tuple[int, int]:
    """Least and greatest negative score with low * score <= 100 * negative <= high * score."""
    return -(-low * score // 100), high * score // 100


def mine(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = SCALE, every: int = EVERY,
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, shifted: int = SHIFTED, labels: int = LABELS,
    shard: int = SHARD, visitors: int = VISITORS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose id is divisible by ``every``; for each anchor and each of its best ``positives``
    of its label, the ``negatives`` best rows of other labels that score between ``low`` and ``high`` per cent of it.
    """
    spark = df.sparkSession
    own_id, label = F.col(id_col).cast("long"), F.col(label_col).cast("long")
    plain = df.select(
        own_id.alias("vec_id"), F.when(own_id % shifted == 0, F.pmod(label + 1, F.lit(labels))).otherwise(label).alias("label"), F.col(vector_col).cast("array<double>").alias("vector")
    ).where("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")

    learned: dict[int, np.ndarray] = {}
    few = plain.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    for chunk in few.to_batches():
        for _, values in matrices(chunk.column(2)):
            if values.shape[1]:
                learned[values.shape[1]] = references(values) if values.shape[1] not in learned else learned[values.shape[1]]
    told = spark.sparkContext.broadcast(learned)

    def centres(length: int) -> np.ndarray:
        if length in told.value:
            return told.value[length]
        return references(np.random.default_rng(length).standard_normal((REFERENCES, length)))

    def filed(batches):
        for batch in batches:
            for some, values in matrices(batch.column(2)):
                length = values.shape[1]
                if not length:
                    continue
                centre, out = centres(length), large(values, scale)
                for which, first in ((~out, 0), (out, LARGE)):
                    if not which.any():
                        continue
                    pick, own = pa.array(some[which]), np.ascontiguousarray(values[which])
                    norm, angles = angles_to(integers(own, scale), centre)
                    file = (angles.argmin(axis=1) + length * FILES + first).astype(np.int32)
                    wide, many = np.arange(len(own) + 1) * length, np.arange(len(own) + 1) * len(centre)
                    yield record(["vec_id", "label", "file", "norm", "angles", "vector"], [
                        batch.column(0).take(pick), batch.column(1).take(pick), file, norm, binaries(angles.reshape(-1), many), binaries(own.reshape(-1), wide),
                    ])

    rows = stored(plain.mapInArrow(filed, ROW), "vectors")
    sizes = rows.groupBy("file").agg(F.count("*").alias("rows"))
    files = stored(sizes.withColumn("shards", F.ceil(F.col("rows") / shard).cast("int")), "files")
    # Ranges of every file, one row for each of at most REFERENCES files of a length of vectors.
    width = F.expr("octet_length(angles) div 8")

    def ranges_of(batches):
        found: dict[int, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            file, norm = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            angles = batch.column(2).to_pylist()
            for f in np.unique(file).tolist():
                at = np.flatnonzero(file == f)
                own = np.frombuffer(b"".join([angles[i] for i in at]), np.float64).reshape(len(at), -1)
                new = [norm[at].min(), norm[at].max(), own.min(axis=0), own.max(axis=0)]
                old = found.get(f)
                found[f] = new if old is None else [min(old[0], new[0]), max(old[1], new[1]), np.minimum(old[2], new[2]), np.maximum(old[3], new[3])]
        for f, (a, b, c, d) in found.items():
            yield record(["file", "low", "high", "least", "most"], [pa.array([f], pa.int32()), [float(a)], [float(b)], pa.array([c.tolist()]), pa.array([d.tolist()])])

    pieces = rows.select("file", "norm", "angles").mapInArrow(ranges_of, "file int, low double, high double, least array<double>, most array<double>")
    spread_out = pieces.select("file", "low", "high", F.posexplode(F.arrays_zip("least", "most")).alias("at", "angle"))
    merged = spread_out.groupBy("file", "at").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("angle.least").alias("least"), F.max("angle.most").alias("most"))
    summary = merged.groupBy("file").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sort_array(F.collect_list(F.struct("at", "least", "most"))).alias("angles"))
    known = {
        r["file"]: (r["shards"], r["low"], r["high"], np.array([x["least"] for x in r["angles"]]), np.array([x["most"] for x in r["angles"]]))
        for r in summary.join(files.select("file", "shards"), "file").collect()
    }
    maps = spark.sparkContext.broadcast(known)
    dealt = (
        rows.join(files.select("file", "shards"), "file").withColumn("shard", F.expr("cast(pmod(xxhash64(vec_id, vector), shards) as int)")).drop("shards")
    )
    anchors = stored(
        rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "label", "vector"]).withColumn("anchor", F.xxhash64("vec_id", "label", "vector")), "anchors"
    )
    first_schema = "anchor long, score decimal(38,0), vec_id long"
    asked = "anchor long, vec_id long, label long, file int, norm double, angles binary, vector binary, asks array<decimal(38,0)>"

    def reach(asks, kind: int) -> tuple[float, float]:
        """The scores that an anchor asks for: anything at home, then at least the floor, then from its first window to its last."""
        if kind < 3:
            return (float(asks[0]) if asks else -math.inf), math.inf
        spans = [w for w in (window_of(int(s), low, high) for s in asks) if w[0] <= w[1]]
        return (float(min(w[0] for w in spans)), float(max(w[1] for w in spans))) if spans else (math.inf, -math.inf)

    def routes(batches):
        """The files whose ranges allow a score that an anchor asks for."""
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column(3).to_numpy()
            asks, kinds = batch.column(7).to_pylist(), batch.column(8).to_numpy()
            norm, angles = batch.column(4).to_numpy(), batch.column(5).to_pylist()
            who, where = [], []
            for length in np.unique(own // FILES).tolist():
                at = np.flatnonzero(own // FILES == length)
                files_of = sorted(f for f in maps.value if f // FILES == length)
                lows, highs = (np.array([maps.value[f][k] for f in files_of]) for k in (1, 2))
                least, most = (np.array([maps.value[f][k] for f in files_of]) for k in (3, 4))
                mine_ = np.frombuffer(b"".join([angles[i] for i in at]), np.float64).reshape(len(at), -1)
                down, up = bounds(norm[at], mine_, lows, highs, least, most)
                wide = [reach(asks[i], kinds[i]) for i in at]
                floor, roof = (np.array([x[k] for x in wide]) for k in (0, 1))
                # Doubles of large scores are rounded, less than the bounds are widened.
                meets = (up >= floor[:, None]) & (down <= roof[:, None])
                home = own[at][:, None] == np.array(files_of)[None, :]
                kind = kinds[at][:, None]
                meets = np.where(kind == 1, home, np.where(kind == 2, meets & ~home, meets))
                a, f = np.nonzero(meets)
                who.append(at[a])
                where.append(np.array(files_of)[f])
            who, where = np.concatenate(who), np.concatenate(where).astype(np.int32)
            shards_of = np.array([maps.value[f][0] for f in where.tolist()], np.int32)
            yield record(["anchor", "vec_id", "label", "file", "norm", "angles", "vector", "asks", "shards"], [
                *batch.select([0, 1, 2]).take(pa.array(who)).columns, pa.array(where), *batch.select([4, 5, 6, 7]).take(pa.array(who)).columns, pa.array(shards_of),
            ])

    def visit(from_: DataFrame, kind: int, answer, schema: str) -> DataFrame:
        """Stream anchors past the shards they need; kind: 1 their own file, 2 all others that may matter, 3 all that may matter."""
        routed = stored(from_.withColumn("kind", F.lit(kind)).mapInArrow(routes, asked + ", shards int"), "routes")
        there = routed.groupBy("file").agg(F.count("*").alias("visits")).withColumn("copies", F.ceil(F.col("visits") / visitors).cast("int"))
        none = F.lit(None)
        guests = (
            routed.withColumn("shard", F.explode(F.expr("sequence(0, shards - 1)"))).join(there.select("file", "copies"), "file")
            .withColumn("copy", F.expr("cast(pmod(anchor, copies) as int)"))
            .select("file", "shard", "copy", F.lit(1).alias("guest"), "vec_id", "label", "norm", "angles", "vector", "anchor", "asks")
        )
        hosts = (
            dealt.join(there.select("file", "copies"), "file").withColumn("copy", F.explode(F.expr("sequence(0, copies - 1)")))
            .select("file", "shard", "copy", F.lit(0).alias("guest"), "vec_id", "label", "norm", "angles", "vector", none.cast("long").alias("anchor"), none.cast("array<decimal(38,0)>").alias("asks"))
        )
        parts = there.join(files, "file").agg(F.sum(F.col("copies") * F.col("shards"))).first()[0] or 0
        met = hosts.union(guests).repartition(partitions(spark, parts, 1), "file", "shard", "copy").sortWithinPartitions("file", "shard", "copy", "guest")

        def run(batches):
            waiting, place, held = [], None, None
            for batch in batches:
                if not batch.num_rows:
                    continue
                key = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(4)])
                cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    part, now = batch.slice(a, b - a), tuple(key[:3, a].tolist())
                    if now != place:
                        waiting, place, held = [], now, None
                    if key[3, a] == 0:
                        waiting.append(part.select([4, 5, 0, 6, 7, 8]))
                        continue
                    if held is None:
                        held = Shard(pa.Table.from_batches(waiting), scale)
                        waiting = []
                    yield from greet(held, part)

        def greet(held: Shard, part: pa.RecordBatch):
            ids, own_label, norm = (part.column(i).to_numpy() for i in (4, 5, 6))
            angles = np.frombuffer(b"".join(part.column(7).to_pylist()), np.float64).reshape(len(ids), -1)
            vectors = np.frombuffer(b"".join(part.column(8).to_pylist()), np.float64).reshape(len(ids), -1)
            names, asks = part.column(9).to_pylist(), part.column(10).to_pylist()
            for s in range(0, len(ids), GROUP):
                down, up = bounds(norm[s:s + GROUP], angles[s:s + GROUP], *held.ranges)
                out = []
                for j in range(len(down)):
                    i = s + j
                    whole = integers(vectors[i:i + 1], scale)[0]
                    out += [(names[i], *x) for x in answer(held, int(ids[i]), int(own_label[i]), norm[i], angles[i], whole, down[j], up[j], asks[i])]
                if out:
                    yield from pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types[schema], strict=True)], names=heads[schema]).to_batches()

        return met.mapInArrow(run, schema)

    number = pa.decimal128(38, 0)
    second_schema = "anchor long, window int, score decimal(38,0), vec_id long"
    types = {first_schema: [pa.int64(), number, pa.int64()], second_schema: [pa.int64(), pa.int32(), number, pa.int64()]}
    heads = {first_schema: ["anchor", "score", "vec_id"], second_schema: ["anchor", "window", "score", "vec_id"]}

    def look_for_positives(held, own_id, own_label, norm, angles, vector, down, up, asks):
        floor = int(asks[0]) if asks else -(10**37)
        return [(exactly(s), i) for s, i in held.positives(own_id, own_label, norm, angles, vector, down, up, floor, positives)]

    def look_for_negatives(held, own_id, own_label, norm, angles, vector, down, up, asks):
        windows = [window_of(int(s), low, high) for s in asks]
        return [(k, exactly(s), i) for k, s, i in held.negatives(own_label, norm, angles, vector, down, up, windows, negatives)]

    def ranked(found: DataFrame, count: int, *by: str) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)

    names = ["anchor", "vec_id", "label", "file", "norm", "angles", "vector"]
    nothing = F.array().cast("array<decimal(38,0)>")
    at_home = stored(visit(anchors.select(*names, nothing.alias("asks")), 1, look_for_positives, first_schema), "home-positives")
    floors = ranked(at_home, positives, "anchor").groupBy("anchor").agg(F.count("*").alias("have"), F.min("score").alias("floor"))
    further = anchors.join(floors, "anchor", "left").select(*names, F.when(F.col("have") >= positives, F.array("floor")).otherwise(nothing).alias("asks"))
    elsewhere = visit(further, 2, look_for_positives, first_schema)
    chosen = stored(ranked(at_home.union(elsewhere), positives, "anchor").withColumnsRenamed({"rank": "positive_rank", "vec_id": "positive_id", "score": "positive_score"}), "positives")
    numbered = chosen.withColumn("window", F.col("positive_rank") - 1)
    in_order = F.sort_array(F.collect_list(F.struct("window", "positive_score")))
    asking = numbered.groupBy("anchor").agg(in_order["positive_score"].alias("asks"))
    found = ranked(visit(anchors.join(asking, "anchor").select(*names, "asks"), 3, look_for_negatives, second_schema), negatives, "anchor", "window")
    near = F.lit(2**63 - 1).cast("decimal(38,0)")

    def fits(column: str):
        return F.greatest(F.least(F.col(column), near), F.lit(-(2**63)).cast("decimal(38,0)")).cast("long").alias(column)

    return (
        found.select("anchor", "window", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
        .join(numbered.select("anchor", "window", "positive_id", "positive_score"), ["anchor", "window"])
        .join(anchors.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor")
        .select("anchor_id", "positive_id", "rank", "negative_id", fits("positive_score"), fits("negative_score"))
    )
