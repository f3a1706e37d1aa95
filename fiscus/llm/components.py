"""Connected components of a link table, as joins and aggregates over tables in the shared folder.

Each round hooks every node onto its smallest neighbour, follows these hooks to their ends by
repeated joins, and keeps only the links between different ends. Nodes that are no local minimum
leave in each round, so the number of rounds grows with the logarithm of the longest path. A node
with any number of links is one row of the hooks and is never gathered; joins on it can be split.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiscus.llm.common import stored


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node of its component) that connect what the given links connect."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[:len(a)], at[len(a):]
    label = np.arange(len(nodes))
    while True:
        x, y = label[u], label[v]
        open_ = x != y
        if not open_.any():
            break
        u, v, x, y = u[open_], v[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            ahead = label[label]
            if np.array_equal(ahead, label):
                break
            label = ahead
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node that is not the smallest of its component.

    ``links`` has two long columns, in either order, with or without repeats and self-links.
    """
    a, b = links.columns
    hi, lo = F.greatest(a, b), F.least(a, b)
    open_ = stored(links.where(F.col(a) != F.col(b)).select(hi.alias("hi"), lo.alias("lo")).distinct(), "links")
    found = None
    while not open_.isEmpty():
        hooks = stored(open_.groupBy("hi").agg(F.min("lo").alias("lo")).toDF("node", "component"), "hooks")
        while True:
            further = hooks.toDF("component", "further")
            jumped = stored(
                hooks.join(further, "component", "left").select("node", F.coalesce("further", "component").alias("component"), F.col("further").isNotNull().alias("moved")),
                "hooks",
            )
            hooks = jumped.drop("moved")
            if jumped.where("moved").isEmpty():
                break
        if found is None:
            found = hooks
        else:
            found = stored(
                found.join(hooks.toDF("component", "further"), "component", "left").select("node", F.coalesce("further", "component").alias("component")).union(hooks),
                "components",
            )
        ends = open_.join(hooks.toDF("hi", "new_hi"), "hi", "left").join(hooks.toDF("lo", "new_lo"), "lo", "left").select(
            F.coalesce("new_hi", "hi").alias("a"), F.coalesce("new_lo", "lo").alias("b")
        )
        open_ = stored(ends.where("a != b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "links")
    if found is None:
        return open_.toDF("node", "component")
    return found
