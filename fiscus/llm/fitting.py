"""Fits whose data stay in the tasks: loss and slope of every part are worked out where it lies.

The driver holds the parameters and the last few steps only, however long the texts are.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fiscus.llm.common import record, stored

#: Tasks that a fit is worked on by, so slopes that reach the driver at a time, and steps that the curvature is learned from.
PARTS, MEMORY = 8, 8


def gathered(df: DataFrame, label: str) -> DataFrame:
    """``df`` stored in ``PARTS`` files at most, as it is read in every round; for samples of bounded rows."""
    return stored(stored(df, label).coalesce(PARTS), label)


def summed(parts: DataFrame, evaluate: Callable, size: int) -> Callable[[np.ndarray], tuple[float, np.ndarray]]:
    """A function of the parameters: loss and slope over all rows of ``parts``.

    ``evaluate(batch, params)`` gives both for one Arrow batch; there are ``size`` parameters. A task
    gives the driver one row, ``PARTS`` at most together.
    """
    def at(params: np.ndarray) -> tuple[float, np.ndarray]:
        def each(batches):
            loss, slope = 0.0, np.zeros(size)
            for batch in batches:
                if batch.num_rows:
                    more, down = evaluate(batch, params)
                    loss += more
                    slope += down
            yield record(["loss", "slope"], [[loss], pa.array([slope.tobytes()], pa.binary())])

        loss, slope = 0.0, np.zeros(size)
        for row in parts.coalesce(PARTS).mapInArrow(each, "loss double, slope binary").collect():
            loss += row["loss"]
            slope += np.frombuffer(row["slope"])
        return loss, slope

    return at


def minimum(f: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, rounds: int, close: float = 1e-6) -> np.ndarray:
    """The parameters with the least f, by limited-memory quasi-Newton steps with backtracking.

    Ends after ``rounds`` steps, or when a step gains less than the share ``close``.
    """
    x = start.astype(float)
    value, slope = f(x)
    moved: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        way, pulls = slope.copy(), []
        for s, y in reversed(moved):
            pulls.append((s @ way) / (y @ s))
            way -= pulls[-1] * y
        if moved:
            s, y = moved[-1]
            way *= (s @ y) / (y @ y)
        else:
            way /= max(np.abs(way).sum(), 1e-12)
        for (s, y), pull in zip(moved, reversed(pulls), strict=True):
            way += s * (pull - (y @ way) / (y @ s))
        down = slope @ way
        if not down > 0:
            break
        step = 1.0
        while True:
            to = x - step * way
            new, there = f(to)
            if new <= value - 1e-4 * step * down or step < 1e-4:
                break
            step /= 2
        if not new < value:
            break
        s, y = to - x, there - slope
        if s @ y > 1e-12:
            moved = [*moved, (s, y)][-MEMORY:]
        gained = value - new
        x, value, slope = to, new, there
        if gained < close * max(abs(value), 1e-12):
            break
    return x
