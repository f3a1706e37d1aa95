"""Whole orders, interval joins, pages by number, marts that grow by years, sketches."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from fiscus.operators import intervals as I
from fiscus.operators import paging as L
from fiscus.operators import ranks as R
from fiscus.operators import sketches as S
from fiscus.schemas import MEDIAN_SKETCHES, MONTHLY_TAX, YEARLY_GROWTH
from fiscus.sources import marts, ranked, tables
from fiscus.sources.commits import Tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ranks_are_those_of_the_sorted_list(spark):
    rows = [(i, None if i % 7 == 0 else i % 3) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, v int").repartition(6)
    got = R.with_rank(df, [F.col("v").asc_nulls_first(), F.col("id").asc()]).collect()
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    assert [r["id"] for r in sorted(got, key=lambda r: r["rank"])] == [i for i, _ in want]
    assert sorted(r["rank"] for r in got) == list(range(500))
    assert R.with_rank(df.limit(0), [F.col("id")]).count() == 0


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_the_last_value_crosses_ranges(spark, keys):
    rng = random.Random(2)
    # One key holds most rows, null is a key of its own, and values are rare.
    rows = [(i, rng.choice(["a"] * 8 + ["b", None]), f"v{i}" if rng.random() < 0.01 else None) for i in range(3000)]
    df = spark.createDataFrame(rows, "t int, k string, v string").repartition(5)
    got = {r["t"]: r["v"] for r in R.last_seen(df, keys, "t", "v").collect()}
    last = {}
    for t, k, v in rows:
        own = k if keys else ""
        last[own] = v or last.get(own)
        assert got[t] == last[own]


def found(points, bands, keys, closed, low, high):
    """The band with the smallest number that holds each point, by trying all."""
    out = {}
    for j, k, x in points:
        fits = [v for n, bk, a, b, v in bands if x is not None and (not keys or (bk == k and k is not None))
                and (a is None or low(a, x)) and (b is None or high(x, b))
                and (a is None or b is None or (a <= b if closed else a < b))]
        out[j] = min(fits, default=None)
    return out


KINDS = {
    "date": lambda i: datetime.date(1999, 12, 1) + datetime.timedelta(days=i),
    "timestamp": lambda i: datetime.datetime(2000, 1, 1) + datetime.timedelta(seconds=i / 4),
    "double": lambda i: i / 8 - 2.0,
    "string": lambda i: f"{i:03d}ж"[: 1 + i % 4],
    "long": lambda i: i * 10**15,
}


@pytest.mark.parametrize("kind,closed", [("date", True), ("timestamp", False), ("double", True), ("string", True), ("long", False)])
def test_intervals_of_any_ordered_type(spark, kind, closed):
    rng, value = random.Random(kind), KINDS[kind]
    keys = ["k"] if closed else []

    def some():
        return None if rng.random() < 0.1 else value(rng.randrange(60))

    # Overlaps, gaps, open ends, ends before beginnings, single points; a third of the points are one.
    bands = [(i, rng.choice(["a", "b", None]), some(), some(), i) for i in range(40)]
    points = [(j, rng.choice(["a", "b", "c", None]), value(30) if j % 3 == 0 else some()) for j in range(240)]
    got = I.with_interval(
        spark.createDataFrame(points, f"j int, k string, x {kind}"),
        spark.createDataFrame(bands, f"n int, bk string, lo {kind}, hi {kind}, v int").withColumnRenamed("bk", "k" if keys else "bk"),
        "x", "lo", "hi", "n", ["v"], keys, closed,
    )
    want = found(points, bands, keys, closed, lambda a, x: a <= x, lambda x, b: x <= b if closed else x < b)
    assert {r["j"]: r["v"] for r in got.collect()} == want and got.count() == len(points)


@pytest.mark.parametrize("few", [0, 15, 64])
def test_keys_with_few_and_many_intervals(spark, few):
    rng = random.Random(few)
    bands = [(i, rng.choice("aaaabc"), rng.choice([None, *range(40)]), rng.choice([None, *range(60)]), i) for i in range(60)]
    points = [(j, rng.choice(["a", "a", "b", "c", "d", None]), rng.choice([None, *range(70)])) for j in range(400)]
    got = I.with_interval(
        spark.createDataFrame(points, "j int, k string, x int"),
        spark.createDataFrame(bands, "n int, k string, lo int, hi int, v int"), "x", "lo", "hi", "n", ["v"], ["k"], few=few,
    )
    want = found(points, bands, ["k"], True, lambda a, x: a <= x, lambda x, b: x <= b)
    assert {r["j"]: r["v"] for r in got.collect()} == want and got.count() == len(points)


def test_few_intervals_of_a_key_take_one_join_and_no_sorted_pass(spark, monkeypatch):
    def never(*_):
        raise AssertionError("no ranges are sorted for keys with few intervals")

    monkeypatch.setattr(I, "with_rank", never)
    monkeypatch.setattr(I, "last_seen", never)
    bands = spark.range(200).selectExpr("id % 20 k", "int(id) lo", "int(id) + 30 hi", "id n")
    points = spark.range(500).selectExpr("id % 25 k", "int(id % 250) x")
    got = I.with_interval(points, bands, "x", "lo", "hi", "n", ["n"], ["k"])
    want = points.join(bands.where("lo <= 249"), "k", "left").where("x between lo and hi").groupBy("k", "x").agg(F.min("n"))
    assert sorted(tuple(r) for r in got.where("n is not null").distinct().collect()) == sorted(tuple(r) for r in want.collect())
    assert got.count() == 500


def test_intervals_without_rows(spark):
    points = spark.createDataFrame([(1, 5)], "j int, x int")
    bands = spark.createDataFrame([(0, 1, 9, 7)], "n int, lo int, hi int, v int")
    assert I.with_interval(points, bands.limit(0), "x", "lo", "hi", "n", ["v"]).first()["v"] is None
    assert I.with_interval(points.limit(0), bands, "x", "lo", "hi", "n", ["v"]).count() == 0


def test_nested_intervals_cost_few_rows(spark):
    n = 512
    nested = spark.range(n).selectExpr("int(id) n", "int(id) lo", f"int({4 * n} - id) hi", "int(id) v")
    nodes = nested.selectExpr("bigint(lo) a", "bigint(hi) b").select(F.explode(I._nodes("a", "b")))
    assert nodes.count() <= n * 2 * 12
    pieces = I.disjoint_pieces(nested, "lo", "hi", "n", ["v"])
    assert pieces.count() == 2 * n


@pytest.mark.parametrize("column", L.SORTABLE)
@pytest.mark.parametrize("order", ["asc", "desc"])
def test_pages_by_number(spark, make_payers, folder, column, order):
    payers = make_payers(
        range(240), full_name=lambda i: f"Name {i % 3}", registration_district=lambda i: "north" if i % 2 else None,
        employees_count=lambda i: None if i % 5 else i % 4,
    ).select(*L.SORTABLE)
    path = folder("pages")
    ranked.write_ranked(payers, L.order_columns(column, order), path, parts=7)
    want = [r["taxpayer_id"] for r in L.order_by(payers, column, order).collect()]
    for page in (3, 8, 9):
        rows = ranked.ranked_page(spark, path, payers.schema, page, 30)
        assert [r["taxpayer_id"] for r in rows.collect()] == want[30 * (page - 1):30 * page]
        assert all((r["total_count"], r["total_pages"]) == (240, 8) for r in rows.collect())


def test_a_far_page_reads_its_own_rows(spark, make_payers, folder):
    payers, path = make_payers(range(100)).select("taxpayer_id", "inn"), folder("pages")
    many = payers.crossJoin(spark.range(1000)).selectExpr("taxpayer_id * 1000 + id as taxpayer_id", "inn")
    ranked.write_ranked(many, [F.col("taxpayer_id")], path, parts=20)
    page = ranked.ranked_page(spark, path, many.schema, 9000, 10)
    assert [r["taxpayer_id"] for r in page.collect()] == list(range(89_990, 90_000))
    assert "TakeOrdered" in plan(page) and "Exchange" not in plan(page)
    scan = page._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics()
    assert scan.apply("numPartitions").value() == 1 and scan.apply("numOutputRows").value() < 10_000
    with pytest.raises(ValueError):
        ranked.ranked_page(spark, path, many.schema, 0)


def test_pages_of_nothing(spark, make_payers, folder):
    payers = make_payers([1]).select(*L.SORTABLE)
    ranked.write_ranked(payers.limit(0), L.order_columns(), folder("none"))
    assert ranked.ranked_page(spark, folder("none"), payers.schema).count() == 0


def facts_of(make_facts, years):
    return make_facts([(p, y, m, t, (p + 1) * (y - 2000) * m, 1, p) for p in range(6) for y in years for m in (1, 2) for t in ("A", "B", None)])


@pytest.mark.parametrize("mode", ["sum", "median"])
def test_a_mart_grows_by_the_years_it_lacks(spark, make_facts, folder, mode):
    real, none = facts_of(make_facts, range(2015, 2022)), facts_of(make_facts, [2021, 2022])
    kept = Tables(spark, folder("mart"))
    assert marts.fill_growth_years(kept, real, none, range(2015, 2019), mode) == [2015, 2016, 2017, 2018]
    assert marts.fill_growth_years(kept, real, none, range(2015, 2023), mode) == [2019, 2020, 2021, 2022]
    assert marts.fill_growth_years(kept, real, none, range(2015, 2023), mode) == [] and kept.version() == 2
    name = next(n for n, m in marts.GROWTH_MARTS.items() if m == mode)
    columns = YEARLY_GROWTH.names
    got = sorted(map(tuple, kept.read(name, YEARLY_GROWTH).collect()), key=str)
    want = sorted(map(tuple, marts.yearly_growth_rows(real, none, mode).select(*columns).collect()), key=str)
    assert got == want


def test_a_new_year_opens_one_folder(spark, make_facts, folder):
    path = folder("facts")
    tables.write_facts(facts_of(make_facts, range(2015, 2020)).where("tax_type is not null"), path)
    stored = tables.read_table(spark, path, MONTHLY_TAX).select(*MONTHLY_TAX.names)
    year = marts._of_years(stored, stored.limit(0), [2019])
    year.collect()
    assert "PartitionFilters: [isnotnull(yr#" in plan(year) or "(yr#" in plan(year).split("PartitionFilters:")[1][:60]
    leaves = year._jdf.queryExecution().executedPlan().collectLeaves()
    partitions = [leaves.apply(i).metrics() for i in range(leaves.size())]
    assert min(m.apply("numPartitions").value() for m in partitions if m.contains("numPartitions")) == 1


def test_sketches_of_small_groups_are_exact(spark, make_facts, folder):
    facts, none = facts_of(make_facts, [2019, 2020]), facts_of(make_facts, [2021])
    kept = Tables(spark, folder("sketches"))
    marts.fill_sketch_years(kept, facts, none, [2019])
    marts.fill_sketch_years(kept, facts, none, [2019, 2020, 2021])
    assert kept.read("median_sketches", MEDIAN_SKETCHES).count() == 3 * 2 * 3
    for row in marts.sketched_medians(kept, ["yr"]).collect():
        rows = (none if row["yr"] == 2021 else facts).where(F.col("yr") == row["yr"])
        if row["tax_type"]:
            rows = rows.where(F.col("tax_type") == row["tax_type"])
        values = sorted(float(r["income"]) for r in rows.select("income").collect())
        assert row["n_income"] == len(values) and row["income"] in values
        assert values[(len(values) - 1) // 2] <= row["income"] <= values[len(values) // 2]


def test_merged_sketches_stay_within_their_bound(spark):
    n = 200_000
    # Lopsided: one of the finest groups holds nearly all rows; values repeat; some are null.
    df = spark.range(n).selectExpr("if(id % 50 = 0, id % 1000, 7) as g", "if(id % 11 = 0, null, pow(id % 5000, 3)) as income")
    one = S.merged(S.sketched(df, ["g"], ["income"]), [], ["income"])
    got = S.medians(one, [], ["income"]).first()
    ranks = df.agg(F.count("income").alias("n"), F.count_if(F.col("income") < got["income"]).alias("below"),
                   F.count_if(F.col("income") <= got["income"]).alias("upto")).first()
    slack = 2 * S.rank_error() * ranks["n"]
    assert got["n_income"] == ranks["n"] and ranks["below"] - slack <= ranks["n"] / 2 <= ranks["upto"] + slack
    none = S.medians(S.sketched(df.where("income is null"), ["g"], ["income"]), ["g"], ["income"])
    assert none.where("income is not null or n_income <> 0").count() == 0


def test_date_bands_of_the_rules(spark):
    from fiscus.operators import rules as G

    days = spark.createDataFrame([(datetime.date(2020, 1, d),) for d in (1, 5, 9)], "day date")
    bands = spark.createDataFrame([(0, datetime.date(2020, 1, 4), None, 1, 2)], "band int, a date, b date, low int, high int")
    got = {r["day"].day: (r["low"], r["high"]) for r in G.with_price_band_at(days, bands, "day", "a", "b", 60).collect()}
    assert got == {1: (60, 60), 5: (1, 2), 9: (1, 2)}
