"""Scalar functions and tax rules over the logical tables.

The places and activities of the test tables are not those of the real rule tables, so the
rules are run here with small tables keyed on the test data. Some keys are left out on
purpose: defaults, overlaps and gaps are part of the behaviour.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiscus.functions import lookups as K
from fiscus.functions import scalars as S
from fiscus.operators import aggregates as A
from fiscus.operators import joins as J
from fiscus.operators import rules as G
from fiscus.plans.catalogue import question
from fiscus.sources.warehouse import Warehouse

# Rule tables for the test data; NATION_10 to NATION_24 and MIDDLE EAST are left out.
DISTRICTS = [(f"NATION_{n}", 0.8 + n / 10) for n in range(10)]
DISTRICTS = [(name, round(factor, 1)) for name, factor in DISTRICTS]
SEASONAL = [
    (activity, season, weight)
    for activity, weights in {
        "AFRICA": (1.2, 1.0, 0.9, 1.1),
        "AMERICA": (1.1, 1.0, 0.8, 1.2),
        "ASIA": (1.0, 0.8, 0.4, 1.5),
        "EUROPE": (0.9, 1.1, 1.0, 1.0),
    }.items()
    for season, weight in zip(K.SEASONS, weights)
]
BASE = [
    (activity, year, base + 4000 * (year - 1995))
    for activity, base in (("AFRICA", 48000), ("AMERICA", 60000), ("ASIA", 115000), ("EUROPE", 90000))
    for year in range(1995, 2000)
]
POTENTIAL = [("AFRICA", 1200000), ("AMERICA", 1000000), ("ASIA", 1500000), ("EUROPE", 1300000)]
RATIOS = [("AFRICA", 0.75), ("AMERICA", 0.40), ("ASIA", 0.85), ("EUROPE", 0.65)]
RATES = [("1-URGENT", 0.06), ("2-HIGH", 0.20), ("3-MEDIUM", 0.04)]
BANDS = [(0, 1995, 1996, 10000, 30000), (1, 1996, 1998, 55000, 60000), (2, 2000, 2000, 45000, 50000)]
SALARIES = [(1996, 51220), (1997, 56990), (1999, 66390)]

DISTRICT_COLUMNS = "registration_district, factor"
SEASONAL_COLUMNS = "activity_type, season, factor"
BASE_COLUMNS = "activity_type, yr, base_income"
BAND_COLUMNS = "band, year_from, year_to, low, high"


def rows_sql(name: str, columns: str, rows) -> str:
    return f"{name} as ({K.values_sql(columns, rows)})"


SEASON_SQL = """case when mon in (12, 1, 2) then 'winter' when mon in (3, 4, 5) then 'spring'
    when mon in (6, 7, 8) then 'summer' else 'autumn' end"""
WORKERS_SQL = """case when coalesce(employees_count, 0) = 0 then 0.9
    when employees_count <= 2 then 1.0 when employees_count <= 5 then 1.15
    when employees_count <= 10 then 1.3 else 1.5 end"""
JOINED_SQL = f"""joined as (
    select m.*, activity_type, registration_district, taxpayer_type, employees_count,
      {SEASON_SQL} as season
    from monthly_tax m join taxpayer t on m.taxpayer_id = t.taxpayer_id)"""
KEYS = ("taxpayer_id", "yr", "mon", "tax_type")
KEYS_SQL = "taxpayer_id, yr, mon, tax_type"


def facts_of_payers(db: Warehouse) -> DataFrame:
    joined = J.facts_with_payers(db.monthly_tax, db.taxpayer)
    return joined.withColumn("season", S.season(F.col("mon")))


def table(db: Warehouse, columns: str, rows) -> DataFrame:
    return K.values_table(db.spark, columns, rows)


# ------------------------------------------------------------------ scalar functions


@question("season", f"select distinct mon, {SEASON_SQL} as season from tax_all", views="tax_all")
def season(db: Warehouse) -> DataFrame:
    return db.tax_all.select("mon", S.season(F.col("mon")).alias("season")).distinct()


@question("season_normalize", f"""
    select taxpayer_id, yr, mon, tax_type, {SEASON_SQL} as season from monthly_tax""",
    views="monthly_tax")
def season_normalize(db: Warehouse) -> DataFrame:
    names = {english: russian for russian, english in S.SEASON_NAMES.items()}
    label = S.season(F.col("mon"))
    pairs = [F.lit(text) for item in names.items() for text in item]
    stored = F.when(F.col("yr") % 2 == 0, F.element_at(F.create_map(*pairs), label)).otherwise(label)
    rows = db.monthly_tax.select(*KEYS, stored.alias("season"))
    return rows.withColumn("season", S.season_normalize(F.col("season")))


@question("clip_low", """
    select taxpayer_id, yr, mon, tax_type, greatest(cast(income as double) - 100000, 0) as clipped
    from monthly_tax""", views="monthly_tax")
def clip_low(db: Warehouse) -> DataFrame:
    value = F.col("income").cast("double") - 100000
    return db.monthly_tax.select(*KEYS, S.clip_low(value, 0.0).alias("clipped"))


@question("clip_range", """
    select taxpayer_id, yr, mon, tax_type,
      least(greatest(cast(income as double), 50000), 150000) as income,
      least(greatest(transactions, 2), 5) as transactions
    from monthly_tax""", views="monthly_tax")
def clip_range(db: Warehouse) -> DataFrame:
    return db.monthly_tax.select(
        *KEYS,
        S.clip_range(F.col("income").cast("double"), 50000.0, 150000.0).alias("income"),
        S.clip_range(F.col("transactions"), 2, 5).alias("transactions"),
    )


@question("round_half_even", """
    select l_orderkey, l_linenumber, round_even(y_test / 2, 0) as whole,
      round_even(cast(l_linenumber as double) / 2, 0) as half
    from preds""", views="preds")
def round_half_even(db: Warehouse) -> DataFrame:
    return db.preds.select(
        "l_orderkey",
        "l_linenumber",
        S.round_half_even(F.col("y_test") / 2, 0).alias("whole"),
        S.round_half_even(F.col("l_linenumber").cast("double") / 2, 0).alias("half"),
    )


@question("log1p_expm1", """
    select taxpayer_id, yr, mon, tax_type, round(ln(1 + cast(income as double)), 6) as log_income,
      round(exp(ln(1 + cast(income as double))) - 1, 4) as back
    from monthly_tax""", views="monthly_tax")
def log1p_expm1(db: Warehouse) -> DataFrame:
    logged = F.log1p(F.col("income").cast("double"))
    return db.monthly_tax.select(
        *KEYS,
        F.round(logged, 6).alias("log_income"),
        F.round(F.expm1(logged), 4).alias("back"),
    )


@question("abs_sqrt", """
    select l_orderkey, l_linenumber, abs(y_test - y_pred) as abs_error,
      sqrt(abs(y_test - y_pred)) as root from preds""", views="preds")
def abs_sqrt(db: Warehouse) -> DataFrame:
    error = F.abs(F.col("y_test") - F.col("y_pred"))
    return db.preds.select(
        "l_orderkey", "l_linenumber", error.alias("abs_error"), F.sqrt(error).alias("root")
    )


@question("safe_div_pct", """
    select l_orderkey, l_linenumber, (y_test - y_pred) / nullif(y_test, 0) * 100 as error_pct
    from preds""", views="preds")
def safe_div_pct(db: Warehouse) -> DataFrame:
    pct = S.percent_of(F.col("y_test") - F.col("y_pred"), F.col("y_test"))
    return db.preds.select("l_orderkey", "l_linenumber", pct.alias("error_pct"))


@question("null_to_zero", """
    select taxpayer_id, coalesce(employees_count, 0) as employees_count from taxpayer""",
    views="taxpayer")
def null_to_zero(db: Warehouse) -> DataFrame:
    return db.taxpayer.select(
        "taxpayer_id", S.null_to_zero(F.col("employees_count")).alias("employees_count")
    )


@question("fill_constants", """
    select taxpayer_id, m.yr, m.mon, tax_type, coalesce(core_cpi, 0) as core_cpi,
      coalesce(cpi_yoy, 0) as cpi_yoy, coalesce(retail_sales, 0) as retail_sales,
      coalesce(nullif(tax_type, '5-LOW'), 'Unknown') as known_type
    from monthly_tax m left join econ e on m.yr = e.yr and m.mon = e.mon""",
    views="monthly_tax econ")
def fill_constants(db: Warehouse) -> DataFrame:
    rows = J.with_months(db.monthly_tax, db.econ).select(
        *KEYS, "core_cpi", "cpi_yoy", "retail_sales",
        F.nullif(F.col("tax_type"), F.lit("5-LOW")).alias("known_type"),
    )
    return rows.na.fill(0.0, ["core_cpi", "cpi_yoy", "retail_sales"]).na.fill(
        "Unknown", ["known_type"]
    )


@question("sentinel_to_null", """
    select yr, mon, case when mon = 6 then null else cpi_yoy end as cpi_yoy,
      core_cpi from econ""", views="econ")
def sentinel_to_null(db: Warehouse) -> DataFrame:
    text = db.econ.select(
        "yr", "mon",
        F.coalesce(F.col("cpi_yoy").cast("string"), F.lit("..")).alias("cpi_yoy"),
        F.col("core_cpi").cast("string").alias("core_cpi"),
    )
    return text.withColumns({
        c: S.sentinel_to_null(F.col(c)) for c in ("cpi_yoy", "core_cpi")
    })


@question("date_parts", """
    select o_orderkey, cast(year(o_orderdate) as int) as yr, cast(month(o_orderdate) as int) as mon
    from orders""")
def date_parts(db: Warehouse) -> DataFrame:
    text = db.base("orders").select("o_orderkey", F.date_format("o_orderdate", "MM.dd.yyyy").alias("time"))
    day = F.to_date("time", "MM.dd.yyyy")
    return text.select("o_orderkey", F.year(day).alias("yr"), F.month(day).alias("mon"))


@question("ceil_div", """
    select taxpayer_type, count(*) as total, cast(ceil(count(*) / 7.0) as bigint) as pages
    from taxpayer group by taxpayer_type""", views="taxpayer")
def ceil_div(db: Warehouse) -> DataFrame:
    counts = db.taxpayer.groupBy("taxpayer_type").agg(F.count(F.lit(1)).alias("total"))
    return counts.withColumn("pages", S.ceil_div(F.col("total"), 7))


@question("concat_url", f"""
    select taxpayer_id, concat('{S.AVATAR_URL}', full_name) as avatar from taxpayer""",
    views="taxpayer")
def concat_url(db: Warehouse) -> DataFrame:
    return db.taxpayer.select("taxpayer_id", S.avatar_url(F.col("full_name")).alias("avatar"))


@question("tax_type_fallback", """
    select distinct t.taxpayer_id, coalesce(m.tax_type, t.taxpayer_type) as tax_type
    from taxpayer t left join predict m on t.taxpayer_id = m.taxpayer_id""",
    views="taxpayer predict")
def tax_type_fallback(db: Warehouse) -> DataFrame:
    known = db.facts(2001, 2001).select("taxpayer_id", "tax_type").distinct()
    return db.taxpayer.join(known, "taxpayer_id", "left").select(
        "taxpayer_id",
        S.tax_type_or_payer_type(F.col("tax_type"), F.col("taxpayer_type")).alias("tax_type"),
    )


@question("now_stamp", "select taxpayer_id, true as stamped from taxpayer", views="taxpayer")
def now_stamp(db: Warehouse) -> DataFrame:
    stamped = db.taxpayer.withColumn("created_at", F.current_timestamp())
    return stamped.select(
        "taxpayer_id", (F.col("created_at").isNotNull() & (F.col("created_at") <= F.current_timestamp())).alias("stamped")
    )


# ------------------------------------------------------------------ rules


@question("workers_bucket", f"""
    select taxpayer_id, employees_count, cast({WORKERS_SQL} as double) as workers_factor
    from taxpayer""", views="taxpayer")
def workers_bucket(db: Warehouse) -> DataFrame:
    rows = G.with_workers_factor(db.taxpayer.select("taxpayer_id", "employees_count"))
    return rows.withColumn("workers_factor", F.col("workers_factor").cast("double"))


@question("district_factor", f"""
    with {rows_sql("d", DISTRICT_COLUMNS, DISTRICTS)}
    select taxpayer_id, cast(coalesce(factor, 1.0) as double) as district_factor
    from taxpayer t left join d on t.registration_district = d.registration_district""",
    views="taxpayer")
def district_factor(db: Warehouse) -> DataFrame:
    rows = G.with_district_factor(db.taxpayer, table(db, DISTRICT_COLUMNS, DISTRICTS))
    return rows.select("taxpayer_id", F.col("district_factor").cast("double").alias("district_factor"))


@question("seasonal_factor", f"""
    with {JOINED_SQL}, {rows_sql("s", SEASONAL_COLUMNS, SEASONAL)}
    select {KEYS_SQL}, cast(factor as double) as seasonal_factor
    from joined j left join s on j.activity_type = s.activity_type and j.season = s.season""",
    views="monthly_tax taxpayer")
def seasonal_factor(db: Warehouse) -> DataFrame:
    rows = G.with_seasonal_factor(facts_of_payers(db), table(db, SEASONAL_COLUMNS, SEASONAL))
    return rows.select(*KEYS, F.col("seasonal_factor").cast("double").alias("seasonal_factor"))


EXPECTED_SQL = f"""{JOINED_SQL}, {rows_sql("s", SEASONAL_COLUMNS, SEASONAL)},
    {rows_sql("d", DISTRICT_COLUMNS, DISTRICTS)}, {rows_sql("b", BASE_COLUMNS, BASE)},
    expected as (
      select j.*, cast(base_income * s.factor * coalesce(d.factor, 1.0) * {WORKERS_SQL} as double)
        as expected_income
      from joined j left join s on j.activity_type = s.activity_type and j.season = s.season
      left join d on j.registration_district = d.registration_district
      left join b on j.activity_type = b.activity_type and j.yr = b.yr)"""


def expected_income(db: Warehouse) -> DataFrame:
    return G.with_expected_income(
        facts_of_payers(db),
        table(db, BASE_COLUMNS, BASE),
        table(db, SEASONAL_COLUMNS, SEASONAL),
        table(db, DISTRICT_COLUMNS, DISTRICTS),
    )


@question("base_income", f"""
    with {EXPECTED_SQL}
    select {KEYS_SQL}, round(expected_income, 4) as expected_income,
      round(cast(income as double) / expected_income, 8) as income_ratio from expected""",
    views="monthly_tax taxpayer")
def base_income(db: Warehouse) -> DataFrame:
    return expected_income(db).select(
        *KEYS,
        F.round("expected_income", 4).alias("expected_income"),
        F.round("income_ratio", 8).alias("income_ratio"),
    )


@question("expected_tax_flat", f"""
    with {rows_sql("r", "tax_type, rate", RATES)}
    select taxpayer_id, yr, mon, m.tax_type,
      cast(case when rate is null then null when income > 0 then round(income * rate, 2) else 0 end
        as double) as expected_tax
    from monthly_tax m left join r on m.tax_type = r.tax_type""", views="monthly_tax")
def expected_tax_flat(db: Warehouse) -> DataFrame:
    rows = G.with_flat_tax(db.monthly_tax, table(db, "tax_type, rate", RATES))
    return rows.select(*KEYS, F.col("expected_tax").cast("double").alias("expected_tax"))


@question("expected_tax_net", f"""
    with {JOINED_SQL}, {rows_sql("s", SEASONAL_COLUMNS, SEASONAL)},
      {rows_sql("r", "activity_type, ratio", RATIOS)}
    select {KEYS_SQL}, cast(case when ratio * factor is not null then
        round(greatest(income - income * least(ratio * factor, 0.75), 0) * 0.15, 2) end as double)
        as expected_tax
    from joined j left join s on j.activity_type = s.activity_type and j.season = s.season
    left join r on j.activity_type = r.activity_type""", views="monthly_tax taxpayer")
def expected_tax_net(db: Warehouse) -> DataFrame:
    rows = G.with_net_tax(
        facts_of_payers(db),
        table(db, "activity_type, ratio", RATIOS),
        table(db, SEASONAL_COLUMNS, SEASONAL),
    )
    return rows.select(*KEYS, F.col("expected_tax").cast("double").alias("expected_tax"))


@question("expected_tax_patent", f"""
    with {rows_sql("d", DISTRICT_COLUMNS, DISTRICTS)},
      {rows_sql("p", "activity_type, potential_income", POTENTIAL)}
    select taxpayer_id, round(cast(potential_income * coalesce(factor, 1.0) * {WORKERS_SQL} * 0.06
        as double) / 12, 2) as expected_tax
    from taxpayer t left join d on t.registration_district = d.registration_district
    left join p on t.activity_type = p.activity_type""", views="taxpayer")
def expected_tax_patent(db: Warehouse) -> DataFrame:
    rows = G.with_patent_tax(
        db.taxpayer,
        table(db, "activity_type, potential_income", POTENTIAL),
        table(db, DISTRICT_COLUMNS, DISTRICTS),
    )
    return rows.select("taxpayer_id", "expected_tax")


@question("tax_anomaly", f"""
    with {EXPECTED_SQL}, {rows_sql("r", "tax_type, rate", RATES)},
    flagged as (
      select e.tax_type, coalesce(abs(tax - case when rate is not null then
          case when income > 0 then round(income * rate, 2) else 0 end end) > 0.01, false) as wrong,
        coalesce(cast(income as double) / expected_income > 2.0, false) as high,
        coalesce(cast(income as double) / expected_income < 0.5, false) as low
      from expected e left join r on e.tax_type = r.tax_type)
    select tax_type, count(*) as n_rows, cast(sum(cast(wrong as int)) as bigint) as n_tax_anomaly,
      cast(sum(cast(high as int)) as bigint) as n_high_income,
      cast(sum(cast(low as int)) as bigint) as n_low_income,
      100.0e0 * sum(cast(wrong or high or low as int)) / count(*) as anomaly_pct
    from flagged group by tax_type""", views="monthly_tax taxpayer")
def tax_anomaly(db: Warehouse) -> DataFrame:
    rows = G.with_flat_tax(expected_income(db), table(db, "tax_type, rate", RATES))
    return G.anomaly_summary(G.flag_anomalies(rows))


@question("type_share", """
    select taxpayer_type, count(*) as n,
      100.0e0 * count(*) / (select count(*) from taxpayer) as share_pct
    from taxpayer group by taxpayer_type""", views="taxpayer")
def type_share(db: Warehouse) -> DataFrame:
    return A.share_by(db.taxpayer, "taxpayer_type")


BAND_SQL = f"""{rows_sql("b", BAND_COLUMNS, BANDS)},
    by_year as (select yr, min_by(low, band) as low, min_by(high, band) as high
      from (select distinct yr from tax_all) y join b on y.yr between year_from and year_to
      group by yr)"""


@question("price_band_lookup", f"""
    with {BAND_SQL}
    select taxpayer_id, t.yr, mon, tax_type, coalesce(low, 60000) as low,
      coalesce(high, 60000) as high
    from tax_all t left join by_year y on t.yr = y.yr""", views="tax_all")
def price_band_lookup(db: Warehouse) -> DataFrame:
    rows = G.with_price_band(db.tax_all, table(db, BAND_COLUMNS, BANDS))
    return rows.select(*KEYS, "low", "high")


@question("land_value_band", f"""
    with {BAND_SQL}
    select taxpayer_id, t.yr, mon, tax_type, coalesce(low, 10000) * transactions as low_value,
      coalesce(high, 10000) * transactions as high_value
    from tax_all t left join by_year y on t.yr = y.yr""", views="tax_all")
def land_value_band(db: Warehouse) -> DataFrame:
    plots = db.tax_all.withColumn("area", F.col("transactions"))
    rows = G.with_land_value(plots, table(db, BAND_COLUMNS, BANDS), K.LAND_PRICE_DEFAULT)
    return rows.select(*KEYS, "low_value", "high_value")


@question("assets_by_type", """
    select o_custkey as taxpayer_id, l_returnflag as object_type, count(*) as n_objects,
      cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as taxable_base,
      cast(max(l_shipdate) as date) as last_acquired
    from lineitem join orders on l_orderkey = o_orderkey group by 1, 2""")
def assets_by_type(db: Warehouse) -> DataFrame:
    return G.assets_by_type(db.tax_objects)


@question("assets_wide", """
    select o_custkey as taxpayer_id,
      cast(sum(case when l_returnflag = 'A' then cast(l_extendedprice as decimal(18,2)) end)
        as double) as base_a,
      cast(sum(case when l_returnflag = 'N' then cast(l_extendedprice as decimal(18,2)) end)
        as double) as base_n,
      cast(sum(case when l_returnflag = 'R' then cast(l_extendedprice as decimal(18,2)) end)
        as double) as base_r
    from lineitem join orders on l_orderkey = o_orderkey group by 1""")
def assets_wide(db: Warehouse) -> DataFrame:
    return G.assets_wide(db.tax_objects, ["A", "N", "R"])


@question("year_average_lookup", f"""
    with {rows_sql("s", "yr, average", SALARIES)}
    select taxpayer_id, t.yr, mon, tax_type, coalesce(average, 60000) as average,
      cast(coalesce(average, 60000) as double) * 1.5e0 as income_from,
      cast(coalesce(average, 60000) as double) * 3.0e0 as income_to
    from tax_all t left join s on t.yr = s.yr""", views="tax_all")
def year_average_lookup(db: Warehouse) -> DataFrame:
    rows = G.with_average_salary(
        db.tax_all, table(db, "yr, average", SALARIES), K.BUSINESS_SPREAD
    )
    return rows.select(*KEYS, "average", "income_from", "income_to")
