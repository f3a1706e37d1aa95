"""The logical tables against their plain SQL, on lopsided and awkward input."""

import random

import duckdb
import pandas as pd
import pytest

from fiscus.operators import aggregates as A
from fiscus.operators import joins as J
from fiscus.operators import medians
from fiscus.sources.warehouse import Warehouse, with_views


@pytest.fixture(scope="module")
def lopsided(tmp_path_factory):
    """A third of all lines belong to one order, and half of the orders to one customer."""
    rng = random.Random(11)
    folder = tmp_path_factory.mktemp("lopsided")
    orders = pd.DataFrame({
        "o_orderkey": range(400),
        "o_custkey": [0 if i % 2 else rng.randint(0, 39) for i in range(400)],
        "o_orderstatus": "O",
        "o_totalprice": 1.0,
        "o_orderdate": [
            pd.Timestamp(rng.randint(1999, 2001), rng.randint(1, 12), rng.randint(1, 28))
            for _ in range(400)
        ],
        "o_orderpriority": [rng.choice(["1-URGENT", "2-HIGH"]) for _ in range(400)],
    })
    lines = pd.DataFrame({
        "l_orderkey": [7 if i % 3 == 0 else rng.randint(0, 420) for i in range(6000)],
        "l_partkey": 1,
        "l_suppkey": 1,
        "l_linenumber": [i % 7 + 1 for i in range(6000)],
        "l_quantity": 1.0,
        # Prices below zero and products that end on half a cent must round the same way.
        "l_extendedprice": [round(rng.uniform(-500, 100000), 2) if i % 5 else i / 2 for i in range(6000)],
        "l_discount": [rng.randint(0, 10) / 100 for _ in range(6000)],
        "l_tax": [rng.randint(0, 8) / 100 for _ in range(6000)],
        "l_returnflag": "N",
        "l_linestatus": "O",
        "l_shipdate": pd.Timestamp(2000, 1, 1),
    })
    customers = pd.DataFrame({
        "c_custkey": range(40), "c_name": [f"C{i}" for i in range(40)], "c_nationkey": [i % 5 for i in range(40)],
        "c_acctbal": 0.0, "c_mktsegment": ["HOUSEHOLD" if i % 4 == 1 else "MACHINERY" for i in range(40)],
    })
    nations = pd.DataFrame({"n_nationkey": range(5), "n_name": [f"N{i}" for i in range(5)], "n_regionkey": [i % 2 for i in range(5)]})
    regions = pd.DataFrame({"r_regionkey": range(2), "r_name": ["A", "B"]})
    con = duckdb.connect()
    for name, frame in dict(orders=orders, lineitem=lines, customer=customers, nation=nations, region=regions).items():
        for column in frame.select_dtypes("datetime"):
            frame[column] = frame[column].astype("datetime64[us]")
        frame.to_parquet(folder / f"{name}.parquet", index=False)
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return str(folder), con


@pytest.mark.parametrize("view", ["taxpayer", "tax_all", "monthly_tax", "predict", "econ", "preds"])
def test_views_equal_their_sql(spark, lopsided, view):
    from check import compare

    folder, con = lopsided
    df = getattr(Warehouse(spark, folder), view)
    assert df.count() > 0
    assert compare(df, con, with_views(f"select * from {view}", view)) == ""


def test_medians_of_a_hot_regime(spark, lopsided, monkeypatch):
    folder, con = lopsided
    db = Warehouse(spark, folder)
    expected = sorted(con.execute(with_views(
        "select yr, tax_type, median(cast(income as double)) from tax_all "
        "group by grouping sets ((yr), (yr, tax_type))", "tax_all")).fetchall(), key=str)
    for limit in (10**6, 3):
        monkeypatch.setattr(medians, "SMALL_TABLE", 0)
        monkeypatch.setattr(medians.exact_median, "__defaults__", (limit, False, False))
        found = A.by_type_with_total(db.tax_all, "median").select("yr", "tax_type", "income").collect()
        assert sorted((tuple(r) for r in found), key=str) == expected


def test_joins_with_a_hot_payer_do_not_depend_on_how_they_are_run(spark, lopsided):
    folder, _ = lopsided
    db = Warehouse(spark, folder)
    keys = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes"]
    before = {k: spark.conf.get(k) for k in keys}
    first = J.facts_with_payers(db.tax_all, db.taxpayer).collect()
    grid = J.payers_by_tax_type(db.tax_all, db.taxpayer).collect()
    try:
        spark.conf.set(keys[0], "-1")
        spark.conf.set(keys[1], "1b")
        db = Warehouse(spark, folder)
        assert sorted(map(str, J.facts_with_payers(db.tax_all, db.taxpayer).collect())) == sorted(map(str, first))
        assert sorted(map(str, J.payers_by_tax_type(db.tax_all, db.taxpayer).collect())) == sorted(map(str, grid))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_date_ranges_and_columns_reach_the_scan(spark, lopsided):
    db = Warehouse(spark, lopsided[0])
    plan = _plan(db.facts(start_year=2000))
    assert "GreaterThanOrEqual(o_orderdate,2000-01-01" in plan
    assert "LessThan(o_orderdate,2001-01-01" in _plan(db.facts(end_year=2000))
    assert "ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double,l_discount:double,l_tax:double>" in plan


def test_lines_are_added_up_once_for_both_sources(spark, lopsided):
    db = Warehouse(spark, lopsided[0])
    df = A.yearly_growth(db.monthly_tax, db.predict)
    df.collect()
    final = _plan(df).split("Initial Plan")[0]
    assert final.count("[l_orderkey") >= 1
    assert "ReusedExchange [l_orderkey" in final


def test_a_payer_is_looked_up_by_id_in_the_scan(spark, lopsided):
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    db = Warehouse(spark, lopsided[0])
    own = db.of_payer("100000000003")
    df = J.payer_history(own.monthly_tax, own.predict, own.taxpayer, "100000000003")
    everybody = J.payer_history(db.monthly_tax, db.predict, db.taxpayer, "100000000003")
    assert sorted(map(str, df.collect())) == sorted(map(str, everybody.collect())) != []
    final = _plan(df)
    scans = [line for line in final.splitlines() if "FileScan" in line and "l_extendedprice" in line]
    assert scans and all("GreaterThanOrEqual(l_orderkey," in line and "LessThanOrEqual(l_orderkey," in line for line in scans)
    # The lines are cut to the payer's orders where they are read, before any exchange.
    assert "BroadcastHashJoin [l_orderkey" in final


def test_year_ranges_reach_the_scan(spark, lopsided):
    from fiscus.plans import all_questions

    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    for name in ("filter_year_range", "q_monthly_general_type"):
        plan = _plan(all_questions()[name](spark, lopsided[0]))
        assert "GreaterThanOrEqual(o_orderdate,1996-01-01" in plan and "LessThan(o_orderdate,1999-01-01" in plan, name


def test_one_payer_without_orders(spark, lopsided):
    own = Warehouse(spark, lopsided[0]).of_payer("no such payer")
    assert own.monthly_tax.count() == 0
