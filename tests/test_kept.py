"""Kept tables and models, commits of several tables, answers from names, look-ups by INN."""

import uuid
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from fiscus.schemas import MONTHLY_TAX, TAXPAYER, YEARLY_GROWTH
from fiscus.sources import files, marts, metadata, tables
from fiscus.sources.commits import CommitConflict, Tables
from fiscus.sources.store import Store
from fiscus.sources.warehouse import Warehouse


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_name_is_given_once(spark, folder):
    path = folder("log") + "/a/1.json"
    assert files.create_once(spark, path, "first Ж") and not files.create_once(spark, path, "second")
    assert files.read_text(spark, path) == "first Ж" and files.names(spark, folder("log") + "/a") == ["1.json"]
    assert files.names(spark, folder("none")) == [] and not files.exists(spark, folder("none"))
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: files.create_once(spark, folder("race"), str(i)), range(16)))
    assert sum(won) == 1 and files.read_text(spark, folder("race")) == str(won.index(True))


def test_version_follows_the_files(spark, folder):
    spark.range(3).write.parquet(folder("t"))
    first = files.data_version(spark, folder("t"))
    assert files.data_version(spark, folder("t")) == first
    spark.range(3).write.mode("append").parquet(folder("t"))
    assert files.data_version(spark, folder("t")) != first


def test_store_makes_once_and_a_failure_leaves_nothing(spark, folder):
    store, calls = Store(spark, folder("kept")), []

    def make(path):
        calls.append(path)
        spark.range(4).write.parquet(path)
        if len(calls) == 1:
            raise OSError("lost")

    place = store.place("t", "v1", {"a": 1})
    assert place != store.place("t", "v2", {"a": 1})
    with pytest.raises(OSError):
        store.get(place, make)
    assert store.find(place) is None
    with ThreadPoolExecutor(4) as pool:
        found = set(pool.map(lambda _: store.get(place, make), range(4)))
    assert len(calls) == 2 and found == {calls[1]} and spark.read.parquet(*found).count() == 4


@pytest.fixture
def facts(make_facts):
    return make_facts([(p, y, 1, "A", 10 * p, 1, 1) for p in range(20) for y in (2019, 2021, 2022)])


def test_years_come_from_names(spark, facts, folder):
    path = folder("facts")
    tables.write_facts(facts, path)
    assert [r["yr"] for r in metadata.distinct_years(spark, path).collect()] == [2019, 2021, 2022]
    assert metadata.last_year(spark, path).first()["max_year"] == 2022
    assert tuple(metadata.year_range(spark, path).first()) == (2019, 2022, [2019, 2021, 2022])
    assert tuple(metadata.freshness(spark, path, folder("none")).first()) == (2022, None, True)
    for df in (metadata.distinct_years(spark, path), metadata.year_range(spark, path), metadata.last_year(spark, path)):
        assert "FileScan" not in plan(df) and "Exchange" not in plan(df)


def test_no_facts_have_no_years(spark, folder):
    none = folder("none")
    assert metadata.distinct_years(spark, none).count() == metadata.year_range(spark, none).count() == 0
    assert metadata.last_year(spark, none).first()["max_year"] is None
    assert metadata.freshness(spark, none, none).first()["stale"] is False


def test_a_look_up_reads_few_rows(spark, make_payers, folder):
    path = folder("payers")
    payers = make_payers(range(60_000)).withColumn("inn", F.sha2(F.col("taxpayer_id").cast("string"), 256)).repartition(1)
    # One file, not sorted: only the filters of its row groups can tell.
    payers.write.option("parquet.bloom.filter.enabled#inn", "true").option("parquet.block.size", "300000").parquet(path)
    stored = tables.read_table(spark, path, TAXPAYER)
    wanted = payers.where("taxpayer_id = 777").first()["inn"]
    found = stored.where(F.col("inn") == wanted)
    assert [r["taxpayer_id"] for r in found.collect()] == [777]
    assert "EqualTo(inn" in plan(found)
    scan = found._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert scan.metrics().apply("numOutputRows").value() < 60_000 // 2
    tables.write_payers(payers, folder("sorted"))
    assert tables.read_table(spark, folder("sorted"), TAXPAYER).where(F.col("inn") == wanted).count() == 1


def test_one_payer_look_up_does_not_touch_the_kept_tables_of_all(spark):
    db = Warehouse(spark, "/root/testdata/sf0.001")
    one = db.of_payer("100000000007")
    assert one.taxpayer.count() == 1 and db.stored_payers.count() == db.taxpayer.count()
    with pytest.raises(ValueError):
        one.facts_folder  # noqa: B018


def growth_rows(make_facts, last):
    return make_facts([(1, y, 1, t, y - 2000, 1, 1) for y in range(2018, last + 1) for t in "AB"])


def test_both_marts_or_neither(spark, make_facts, folder, monkeypatch):
    root, none = folder("marts"), make_facts([(1, 2030, 1, "A", 1, 1, 1)])
    both = marts.fill_growth_marts(growth_rows(make_facts, 2020), none, root)
    counts = [both.read(n, YEARLY_GROWTH).count() for n in marts.GROWTH_MARTS]
    assert both.version() == 1 and counts == [11, 11]
    # A failure between the two writes.
    name = "yearly_growth_median"
    rows = {n: both.read(n, YEARLY_GROWTH).withColumn("yr", F.col("yr") + 100) for n in marts.GROWTH_MARTS}
    rows[name] = rows[name].withColumn("income_total", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        both.append(rows, 1)
    assert both.version() == 1 and [both.read(n, YEARLY_GROWTH).count() for n in marts.GROWTH_MARTS] == counts
    assert marts.fill_growth_marts(growth_rows(make_facts, 2020), none, root).version() == 1
    later = marts.fill_growth_marts(growth_rows(make_facts, 2021), none, root)
    assert later.version() == 2 and later.read(name, YEARLY_GROWTH).where("yr = 2021").count() == 3
    assert later.read(name, YEARLY_GROWTH, 1).count() == 11


def test_a_second_writer_notices_and_each_key_is_stored_once(spark, make_facts, folder):
    both = Tables(spark, folder("marts"))
    rows = spark.createDataFrame([(2020, "A")], "yr int, tax_type string")
    both.append({"t": rows}, 0)
    with pytest.raises(CommitConflict):
        both.append({"t": rows}, 0)
    none = make_facts([(1, 2030, 1, "A", 1, 1, 1)])
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda last: marts.fill_growth_marts(growth_rows(make_facts, last), none, folder("race")), (2020, 2021, 2022)))
    raced = Tables(spark, folder("race"))
    for name in marts.GROWTH_MARTS:
        found = raced.read(name, YEARLY_GROWTH)
        assert found.count() == found.select("yr", "tax_type").distinct().count() == 17


def test_lines_are_joined_once_for_stored_facts_and_the_economy(spark, monkeypatch):
    db, calls = Warehouse(spark, "/root/testdata/sf0.001"), []
    own = Warehouse.facts
    monkeypatch.setattr(Warehouse, "facts", lambda self, *years, **named: calls.append(years) or own(self, *years, **named))
    monkeypatch.setattr(Warehouse, "version", f"of this test {uuid.uuid4()}")
    kept = [db.stored_facts, db.stored_predicted, db.stored_econ]
    assert len(calls) == 1
    for got, want in zip(kept, [db.monthly_tax, db.predict.select(*MONTHLY_TAX.names), db.econ], strict=True):
        names = want.columns
        assert sorted(map(str, got.select(names).collect())) == sorted(map(str, want.collect()))
