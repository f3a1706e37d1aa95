"""Best-fit packing of tokenised documents by a configuration linear program.

A document longer than a sequence is cut from its end into full pieces, so that only its first
piece is short. The program has one variable for each way to fill a sequence (a configuration)
and one row for each piece length: use as few sequences as cover the histogram of lengths.
Multiplicative weights solve it: a length that is covered less than others weighs more, and each
round prices the best configuration under these weights by a knapsack program over token counts.
A share of the solution is rounded down; what is left over is placed best-fit, longest first.

The histogram has at most one row for each length, whatever the input, and is all that the
driver sees. Every piece finds its place from its rank among the pieces of its length; ranks are
counted within the tasks that cut the documents, and the tasks' counts are added up in order.

Null and empty texts hold only the end mark. Repeated rows are documents of their own.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fiscus.llm.bpe import CHUNK, load
from fiscus.llm.common import chunks_of, ids_and_texts, record, stored

CAPACITY = 1024
END_ID = 2
#: Equal steps of the solution, how strongly less covered lengths gain weight, and the shares of the
#: solution that rounding tries to keep: the more is left over, the better its lengths go together.
ROUNDS, RATE, SHARES = 400, 2.0, (0.75, 0.5, 0.25)
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, place long"


def cut_documents(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents, with the task that cut each and its place among that task's pieces of its length."""
    shared = df.sparkSession.sparkContext.broadcast(load(path))

    def run(batches):
        model, seen, task = shared.value, np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for chunk in chunks_of(batches, CHUNK):
            ids, at = model.encode(chunk.column(1).to_pylist())
            ids = np.insert(ids, at[1:], end_id).astype("<u4")
            sizes = np.diff(at) + 1
            at = np.cumsum(sizes) - sizes
            many = -(-sizes // capacity)
            row = np.repeat(np.arange(len(sizes)), many)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            short = sizes - (many - 1) * capacity
            start = np.where(piece == 0, 0, short[row] + (piece - 1) * capacity)
            length = np.where(piece == 0, short[row], capacity)
            data = memoryview(ids.tobytes())
            begin = ((at[row] + start) * 4).tolist()
            crc = [zlib.crc32(data[b:b + 4 * n]) for b, n in zip(begin, length.tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            counts = np.bincount(length, minlength=capacity + 1)
            place = np.empty(len(length), np.int64)
            place[order] = np.arange(len(length)) - np.repeat(np.cumsum(counts) - counts, counts)
            place += seen[length]
            seen += counts
            yield record(
                ["doc_id", "piece", "start", "length", "ids_crc32", "task", "place"],
                [chunk.column(0).take(pa.array(row)), piece.astype(np.int32), start, length, pa.array(crc, pa.int64()), np.full(len(row), task, np.int32), place],
            )

    return ids_and_texts(df, id_col, text_col).mapInArrow(run, PIECES)


def price(values: np.ndarray, lengths: np.ndarray, capacity: int) -> dict[int, int]:
    """The configuration of largest value: how often it holds each length (knapsack with repeats)."""
    best, chosen = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        n = fits[room]
        best[room], chosen[room] = best[room - 1], -1
        if n:
            sums = best[room - lengths[:n]] + values[:n]
            k = int(sums.argmax())
            if sums[k] > best[room]:
                best[room], chosen[room] = sums[k], k
    used: dict[int, int] = defaultdict(int)
    room = capacity
    while room > 0:
        if (k := chosen[room]) < 0:
            room -= 1
        else:
            used[int(lengths[k])] += 1
            room -= int(lengths[k])
    return dict(used)


def solve(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> dict[tuple, float]:
    """How much of each configuration a near-optimal fractional cover uses; a configuration is ((length, times), ...).

    About ``rounds`` equal steps; lengths whose rest is smaller than a step take steps of their own.
    """
    lengths = np.array(sorted(histogram))
    need = np.array([histogram[x] for x in lengths.tolist()], float)
    where = {x: i for i, x in enumerate(lengths.tolist())}
    covered, use = np.zeros(len(lengths)), defaultdict(float)
    tokens = need * lengths
    equal = tokens.sum() / capacity / rounds
    while (open_ := covered < 1).any():
        mean = (covered * tokens).sum() / tokens.sum()
        values = lengths[open_] / capacity * np.exp(RATE * (mean - covered[open_]))
        config = price(values, lengths[open_], capacity)
        at = np.array([where[x] for x in config])
        times = np.array([config[x] for x in config], float)
        step = min(((1 - covered[at]) * need[at] / times).min(), equal)
        use[tuple(sorted(config.items(), reverse=True))] += step
        covered[at] += times * step / need[at]
        covered[at[(1 - covered[at]) * need[at] < 1e-6]] = 1
    return dict(use)


def fill(histogram: dict[int, int], capacity: int) -> dict[tuple, int]:
    """Best-fit decreasing on a histogram: sequences with the same content are placed together."""
    open_: dict[int, dict[tuple, int]] = defaultdict(lambda: defaultdict(int))
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            gap = min((g for g, x in open_.items() if g >= length and x), default=None)
            if gap is None:
                times = min(capacity // length, left)
                many = left // times
                open_[capacity - times * length][(length,) * times] += many
                left -= many * times
                continue
            content, many = next(iter(open_[gap].items()))
            times = min(gap // length, left)
            many = min(many, left // times)
            open_[gap][content] -= many
            if not open_[gap][content]:
                del open_[gap][content]
            open_[gap - times * length][(*content, *(length,) * times)] += many
            left -= many * times
    total: dict[tuple, int] = defaultdict(int)
    for contents in open_.values():
        for content, many in contents.items():
            counts: dict[int, int] = defaultdict(int)
            for x in content:
                counts[x] += 1
            total[tuple(sorted(counts.items(), reverse=True))] += many
    return dict(total)


def _rounded(histogram: dict[int, int], use: dict[tuple, float], share: float, capacity: int) -> dict[tuple, int]:
    """That share of the solution rounded down, fullest configurations first, and the rest best-fit."""
    left, made = dict(histogram), defaultdict(int)
    for config in sorted(use, key=lambda c: (capacity - sum(a * b for a, b in c), -use[c], c)):
        many = min(int(use[config] * share + 1e-6), *(left[x] // times for x, times in config))
        if many > 0:
            made[config] += many
            for x, times in config:
                left[x] -= many * times
    for config, many in fill({k: v for k, v in left.items() if v}, capacity).items():
        made[config] += many
    return made


def plan(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[tuple, int]]:
    """Configurations and how many sequences have each; together they hold exactly the histogram."""
    left = {k: v for k, v in histogram.items() if v}
    whole = left.pop(capacity, 0)
    made: dict[tuple, int] = defaultdict(int)
    if whole:
        made[((capacity, 1),)] = whole
    if left:
        use = solve(left, capacity, rounds)
        tries = [_rounded(left, use, share, capacity) for share in SHARES]
        for config, many in min(tries, key=lambda x: sum(x.values())).items():
            made[config] += many
    return sorted(made.items())


def places(made: list[tuple[tuple, int]]) -> dict[str, np.ndarray]:
    """For each length, which ranks go to which sequences: sorted by length and first rank."""
    rows, used, sequence = [], defaultdict(int), 0
    for config, many in made:
        offset = 0
        for length, times in config:
            rows.append((length, used[length], sequence, times, offset))
            used[length] += many * times
            offset += length * times
        sequence += many
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "sequence", "times", "offset"), table.T, strict=True))


def pack(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    pieces = stored(cut_documents(df, path, id_col, text_col, capacity, end_id), "pieces")
    tasks = stored(pieces.groupBy("task", "length").agg(F.count("*").alias("pieces")), "task-lengths")
    histogram = {r["length"]: r["n"] for r in tasks.groupBy("length").agg(F.sum("pieces").alias("n")).collect()}
    table = places(plan(histogram, capacity, rounds))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = stored(tasks.select("task", "length", F.coalesce(F.sum("pieces").over(before), F.lit(0)).alias("first")), "first-ranks")

    def run(batches):
        keys = table["length"] * (1 << 44) + table["rank"]
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            at = np.searchsorted(keys, length * (1 << 44) + rank, side="right") - 1
            inside = rank - table["rank"][at]
            times = table["times"][at]
            yield record(
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
                [*[batch.column(i) for i in range(5)], table["sequence"][at] + inside // times, table["offset"][at] + inside % times * length],
            )

    ranked = pieces.join(first, ["task", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("place")).alias("rank")
    )
    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
