import random
import statistics

import pytest
from pyspark.sql import functions as F

from fiscus.operators import medians
from fiscus.operators.medians import bracketed_median, builtin_median, exact_median


def rows(df, keys):
    return sorted((tuple(r) for r in df.select(*keys, "a", "b").collect()), key=str)


@pytest.fixture(scope="module")
def values(spark):
    rng = random.Random(7)
    data = []
    for _ in range(6000):  # a hot group, heavy tail
        data.append(("hot", 1, round(rng.paretovariate(0.6) * 1000, 2), float(rng.randint(0, 3))))
    data += [("odd", 1, float(v), -float(v)) for v in range(11)]
    data += [("even", 1, float(v), -float(v)) for v in range(10)]
    data += [("one", 2, 5.0, None), ("nulls", 2, None, None), ("nulls", 2, None, None)]
    data += [(None, 3, float(v), 1.0) for v in range(4)]
    data += [("same", 4, 7.5, 7.5)] * 500
    data += [("split", 5, 0.0, 0.0)] * 50 + [("split", 5, 1e12, -1e12)] * 50
    return spark.createDataFrame(data, "k string, g int, a double, b double").repartition(7)


@pytest.mark.parametrize("limit", [20, 10**6])
def test_bracketing_equals_the_built_in_median(values, limit):
    keys = ["k", "g"]
    expected = rows(builtin_median(values, keys, ["a", "b"]), keys)
    assert rows(bracketed_median(values, keys, ["a", "b"], limit), keys) == expected


def test_a_bad_sketch_cannot_change_the_result(values, monkeypatch):
    # Proposals that are far off must be rejected by the exact counts.
    monkeypatch.setattr(
        medians, "_sketch",
        lambda v: F.array(*[F.max(v) for _ in range(medians.GRID + 1)]).alias("grid"),
    )
    expected = rows(builtin_median(values, ["k"], ["a", "b"]), ["k"])
    assert rows(bracketed_median(values, ["k"], ["a", "b"], 5), ["k"]) == expected


def test_whole_table_as_one_group(spark, monkeypatch):
    monkeypatch.setattr(medians, "SMALL_TABLE", 0)
    data = [float(v * v % 1009) for v in range(3001)]
    df = spark.createDataFrame([(v,) for v in data], "x double")
    for limit in (10, 10**6):
        assert exact_median(df, [], ["x"], limit).first()[0] == statistics.median(data)


def test_the_route_depends_on_the_largest_group(values, monkeypatch):
    used = []
    monkeypatch.setattr(medians, "SMALL_TABLE", 0)
    for name in ("builtin_median", "bracketed_median"):
        route = getattr(medians, name)
        monkeypatch.setattr(medians, name, lambda *a, _r=route, _n=name: used.append(_n) or _r(*a))
    exact_median(values, ["k"], ["a"], 10**6)
    exact_median(values, ["k"], ["a"], 5999)
    exact_median(values, ["k"], ["a"], 10, bounded_by_key=True)
    # Only the hot group is bracketed; the small ones next to it are not.
    assert used == ["builtin_median", "builtin_median", "bracketed_median", "builtin_median"]
    # A table that fits into one task as a whole needs no bracketing.
    monkeypatch.setattr(medians, "SMALL_TABLE", 10**6)
    exact_median(values, ["k"], ["a"], 10)
    assert used[-1] == "builtin_median"


def test_large_and_small_groups_together(values, monkeypatch):
    monkeypatch.setattr(medians, "SMALL_TABLE", 0)
    keys = ["k", "g"]
    expected = rows(builtin_median(values, keys, ["a", "b"]), keys)
    for limit in (3, 100):
        assert rows(exact_median(values, keys, ["a", "b"], limit), keys) == expected


def test_no_rows(spark):
    empty = spark.createDataFrame([], "k string, a double")
    assert exact_median(empty, ["k"], ["a"]).count() == 0
