"""Selections, joins, aggregates, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiscus.functions import scalars as S
from fiscus.functions.lookups import ECON_SCENARIO
from fiscus.operators import aggregates as A
from fiscus.operators import filters as P
from fiscus.operators import joins as J
from fiscus.operators import metrics as R
from fiscus.operators import naming as N
from fiscus.operators import paging as L
from fiscus.plans.catalogue import question
from fiscus.schemas import MEASURES, PREDICT
from fiscus.sources import metadata, tables
from fiscus.sources.warehouse import Warehouse

ONE_INN = "100000000007"
GROWTH_SQL = """
  (income - lag(income) over w) / nullif(lag(income) over w, 0) * 100 as income_growth,
  (transactions - lag(transactions) over w)
    / nullif(cast(lag(transactions) over w as double), 0) * 100 as transactions_growth,
  (tax - lag(tax) over w) / nullif(lag(tax) over w, 0) * 100 as tax_growth"""
SUMS_SQL = """cast(sum(income) as double) as income,
  cast(sum(transactions) as bigint) as transactions, cast(sum(tax) as double) as tax"""
MEDIANS_SQL = """round(median(cast(income as double)), 4) as income,
  round(median(cast(transactions as double)), 4) as transactions,
  round(median(cast(tax as double)), 4) as tax"""
AS_DOUBLES_SQL = "cast(income as double) as income, transactions, cast(tax as double) as tax"


def as_doubles(df: DataFrame) -> DataFrame:
    return df.withColumns({"income": F.col("income").cast("double"), "tax": F.col("tax").cast("double")})


def rounded(df: DataFrame, *names: str, digits: int = 4) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


# ------------------------------------------------------------------ scans and projections


@question("scan_sql", """
    select yr, mon, cast(sum(income) as double) as total_income
    from monthly_tax where tax_type = '2-HIGH' and yr >= 1997 group by yr, mon""",
    views="monthly_tax")
def scan_sql(db: Warehouse) -> DataFrame:
    return tables.run_sql(
        db.spark,
        """select yr, mon, cast(sum(income) as double) as total_income
           from {facts} where tax_type = :tax_type and yr >= :start group by yr, mon""",
        args={"tax_type": "2-HIGH", "start": 1997},
        facts=db.recorded(1997),
    )


@question("monthly_data_raw", """
    select yr, mon, cast(income as double) as total_income,
      transactions as total_transactions, cast(tax as double) as total_tax
    from predict where tax_type = '3-MEDIUM' and yr >= 2000 and yr <= 2001
    order by yr, mon""", views="predict")
def monthly_data_raw(db: Warehouse) -> DataFrame:
    source = tables.monthly_source(db, "predict")
    rows = P.monthly_rows(source, "3-MEDIUM", 2000, 2001)
    return rows.withColumns({c: F.col(c).cast("double") for c in ("total_income", "total_tax")})


@question("filter_optional_conj", f"""
    select taxpayer_id, yr, mon, {AS_DOUBLES_SQL} from monthly_tax
    where tax_type = '5-LOW' and yr <= 1997""", views="monthly_tax")
def filter_optional_conj(db: Warehouse) -> DataFrame:
    rows = P.where_all(
        db.recorded(None, 1997), P.equals("tax_type", "5-LOW"), P.at_least("yr", None), P.at_most("yr", 1997)
    )
    return as_doubles(rows).drop("tax_type")


@question("filter_year_range", f"""
    select taxpayer_id, yr, mon, tax_type, {AS_DOUBLES_SQL} from monthly_tax
    where yr >= 1996 and yr <= 1998""", views="monthly_tax")
def filter_year_range(db: Warehouse) -> DataFrame:
    return as_doubles(P.in_years(db.recorded(1996, 1998), 1996, 1998))


@question("filter_tax_type", """
    select taxpayer_id, full_name, inn from taxpayer where taxpayer_type = 'MACHINERY'""",
    views="taxpayer")
def filter_tax_type(db: Warehouse) -> DataFrame:
    return P.where_all(db.taxpayer, P.equals("taxpayer_type", "MACHINERY")).select(
        "taxpayer_id", "full_name", "inn"
    )


@question("filter_null_total", f"""
    select yr, {SUMS_SQL} from monthly_tax group by yr""", views="monthly_tax")
def filter_null_total(db: Warehouse) -> DataFrame:
    mart = A.by_type_with_total(db.monthly_tax)
    return mart.where(P.same_or_total("tax_type", None)).drop("tax_type")


@question("mart_lookup", f"""
    select yr, tax_type, {SUMS_SQL} from monthly_tax
    where tax_type = '1-URGENT' and yr between 1996 and 1999
    group by yr, tax_type order by yr""", views="monthly_tax")
def mart_lookup(db: Warehouse) -> DataFrame:
    return P.summary_rows(A.by_type_with_total(db.monthly_tax), "1-URGENT", 1996, 1999)


@question("point_lookup_all", f"select * from taxpayer where inn = '{ONE_INN}'", views="taxpayer")
def point_lookup_all(db: Warehouse) -> DataFrame:
    return P.payer_by_inn(db.stored_payers, ONE_INN)


@question("point_lookup_profile", f"""
    select taxpayer_id, full_name, passport_number, inn, taxpayer_type, activity_type,
      registration_district, has_employees, employees_count
    from taxpayer where inn = '{ONE_INN}'""", views="taxpayer")
def point_lookup_profile(db: Warehouse) -> DataFrame:
    return P.profile_by_inn(db.stored_payers, ONE_INN)


@question("filter_contains", "select taxpayer_id, inn from taxpayer where inn like '%42%'",
          views="taxpayer")
def filter_contains(db: Warehouse) -> DataFrame:
    return P.where_all(db.taxpayer, P.contains("inn", "42")).select("taxpayer_id", "inn")


@question("filter_district", """
    select taxpayer_id, registration_district from taxpayer
    where registration_district = 'NATION_3'""", views="taxpayer")
def filter_district(db: Warehouse) -> DataFrame:
    return P.where_all(db.taxpayer, P.equals("registration_district", "NATION_3")).select(
        "taxpayer_id", "registration_district"
    )


@question("rename_measures", f"""
    select yr as "Year", income as "Income", transactions as "Transactions", tax as "Tax"
    from (select yr, {SUMS_SQL} from monthly_tax group by yr)""", views="monthly_tax")
def rename_measures(db: Warehouse) -> DataFrame:
    return N.public(A.yearly(db.monthly_tax))


@question("normalize_types", """
    select cast(taxpayer_id as bigint) as taxpayer_id, has_employees,
      cast(employees_count as int) as employees_count from taxpayer""", views="taxpayer")
def normalize_types(db: Warehouse) -> DataFrame:
    text = db.taxpayer.select(
        F.col("taxpayer_id").cast("string").alias("taxpayer_id"),
        F.col("has_employees").cast("int").alias("has_employees"),
        F.col("employees_count").cast("string").alias("employees_count"),
    )
    return P.normalize_types(text)


@question("user_projection", f"""
    select taxpayer_id as id, full_name as name, inn, registration_district, has_employees,
      nullif(employees_count, 0) as employees_count,
      concat('{S.AVATAR_URL}', full_name) as avatar_src
    from taxpayer""", views="taxpayer")
def user_projection(db: Warehouse) -> DataFrame:
    cards = P.user_records(db.taxpayer)
    return cards.select("*", F.col("avatar.src").alias("avatar_src")).drop("avatar")


FEATURES_SQL = """
    select yr, mon, case when mon in (12, 1, 2) then 'winter' when mon in (3, 4, 5) then 'spring'
        when mon in (6, 7, 8) then 'summer' else 'autumn' end as season,
      tax_type, taxpayer_type, activity_type, registration_district, has_employees,
      employees_count
    from monthly_tax m join taxpayer t on m.taxpayer_id = t.taxpayer_id"""


@question("feature_projection", FEATURES_SQL, views="monthly_tax taxpayer")
def feature_projection(db: Warehouse) -> DataFrame:
    joined = J.facts_with_payers(db.monthly_tax, db.taxpayer)
    return P.model_features(joined.withColumn("season", S.season(F.col("mon"))))


@question("align_schema", """
    select taxpayer_id, cast(null as string) as full_name, cast(null as string) as inn, yr, mon,
      cast(income as double) as income, cast(transactions as bigint) as transactions,
      cast(tax as double) as tax, tax_type, cast(null as string) as taxpayer_type,
      cast(null as string) as activity_type, cast(null as string) as registration_district,
      cast(null as boolean) as has_employees, cast(null as int) as employees_count
    from monthly_tax""", views="monthly_tax")
def align_schema(db: Warehouse) -> DataFrame:
    return P.align_schema(db.monthly_tax, PREDICT)


@question("drop_columns", """
    select taxpayer_id, yr, mon, tax_type, cast(income as double) as income, transactions
    from predict""", views="predict")
def drop_columns(db: Warehouse) -> DataFrame:
    return as_doubles(db.predict).drop(
        "tax", "full_name", "inn", "taxpayer_type", "activity_type",
        "registration_district", "has_employees", "employees_count",
    )


@question("records_json", """
    select cast(to_json({'taxpayer_id': taxpayer_id, 'full_name': full_name, 'inn': inn,
      'has_employees': has_employees, 'employees_count': employees_count}) as string) as record
    from taxpayer""", views="taxpayer")
def records_json(db: Warehouse) -> DataFrame:
    return P.json_records(db.taxpayer.select(
        "taxpayer_id", "full_name", "inn", "has_employees", "employees_count"
    ))


# ------------------------------------------------------------------ joins


@question("join_fact_payer", f"""
    select m.taxpayer_id, yr, mon, tax_type, {AS_DOUBLES_SQL}, full_name, inn, taxpayer_type,
      activity_type, registration_district, has_employees, employees_count
    from monthly_tax m join taxpayer t on m.taxpayer_id = t.taxpayer_id""",
    views="monthly_tax taxpayer")
def join_fact_payer(db: Warehouse) -> DataFrame:
    return as_doubles(J.facts_with_payers(db.monthly_tax, db.taxpayer))


PAYERS_BY_TYPE_SQL = """
    select distinct t.taxpayer_id, full_name, inn, taxpayer_type, activity_type,
      registration_district, has_employees, employees_count, tax_type
    from taxpayer t join monthly_tax m on t.taxpayer_id = m.taxpayer_id"""


@question("payers_by_tax_type", PAYERS_BY_TYPE_SQL, views="monthly_tax taxpayer")
def payers_by_tax_type(db: Warehouse) -> DataFrame:
    return J.payers_by_tax_type(db.monthly_tax, db.taxpayer)


@question("payers_of_one_tax_type", PAYERS_BY_TYPE_SQL + " where tax_type = '2-HIGH'",
          views="monthly_tax taxpayer")
def payers_of_one_tax_type(db: Warehouse) -> DataFrame:
    return J.payers_by_tax_type(db.monthly_tax, db.taxpayer, "2-HIGH")


HISTORY_SQL = """
    select t.inn, m.yr, m.mon, m.tax_type, m.income, m.transactions, m.tax
    from monthly_tax m join taxpayer t on m.taxpayer_id = t.taxpayer_id
    union all
    select inn, yr, mon, tax_type, income, transactions, tax from predict"""


@question("payer_history", f"""
    select inn, yr, mon, tax_type, {AS_DOUBLES_SQL} from ({HISTORY_SQL})""",
    views="monthly_tax taxpayer predict")
def payer_history(db: Warehouse) -> DataFrame:
    return as_doubles(J.payer_history(db.monthly_tax, db.predict, db.taxpayer))


@question("payer_history_years", f"""
    select inn, yr, mon, tax_type, {AS_DOUBLES_SQL} from ({HISTORY_SQL})
    where inn = '{ONE_INN}' and yr >= 1999 and yr <= 2001""",
    views="monthly_tax taxpayer predict")
def payer_history_years(db: Warehouse) -> DataFrame:
    own = db.of_payer(ONE_INN)
    return as_doubles(
        J.payer_history(own.recorded(1999, 2001), own.predict, own.taxpayer, ONE_INN, 1999, 2001)
    )


@question("join_econ_left", f"""
    select taxpayer_id, m.yr, m.mon, tax_type, {AS_DOUBLES_SQL}, core_cpi, cpi_yoy, retail_sales
    from monthly_tax m left join econ e on m.yr = e.yr and m.mon = e.mon""",
    views="monthly_tax econ")
def join_econ_left(db: Warehouse) -> DataFrame:
    return as_doubles(J.with_months(db.monthly_tax, db.econ))


GRID_SQL = f"""
    select p.*, cast(2001 as int) as yr, cast(mon as int) as mon,
      case when mon in (12, 1, 2) then 'winter' when mon in (3, 4, 5) then 'spring'
        when mon in (6, 7, 8) then 'summer' else 'autumn' end as season
    from ({PAYERS_BY_TYPE_SQL}) p,
      (values (1),(2),(3),(4),(5),(6),(7),(8),(9),(10),(11),(12)) months(mon)"""


@question("forecast_grid", GRID_SQL, views="monthly_tax taxpayer")
def forecast_grid(db: Warehouse) -> DataFrame:
    return J.forecast_grid(J.payers_by_tax_type(db.monthly_tax, db.taxpayer), 2001)


@question("anti_existing", f"""
    select yr, tax_type, {SUMS_SQL} from monthly_tax
    where tax_type <> '1-URGENT' and yr <> 1997 group by yr, tax_type""", views="monthly_tax")
def anti_existing(db: Warehouse) -> DataFrame:
    rows = A.by_type_with_total(db.monthly_tax)
    stored = rows.where(
        F.col("tax_type").isNull() | (F.col("tax_type") == "1-URGENT") | (F.col("yr") == 1997)
    )
    return J.rows_absent_from(rows, stored.select("yr", "tax_type"), ["yr", "tax_type"])


@question("attach_scenario", f"""
    select taxpayer_id, tax_type, mon,
      {", ".join(f"cast({v} as double) as {k}" for k, v in ECON_SCENARIO.items())}
    from ({GRID_SQL})""", views="monthly_tax taxpayer")
def attach_scenario(db: Warehouse) -> DataFrame:
    grid = J.forecast_grid(J.payers_by_tax_type(db.monthly_tax, db.taxpayer), 2001)
    return J.attach_scenario(grid.select("taxpayer_id", "tax_type", "mon"), ECON_SCENARIO)


# ------------------------------------------------------------------ aggregates


@question("yearly_sum", f"select yr, {SUMS_SQL} from monthly_tax group by yr", views="monthly_tax")
def yearly_sum(db: Warehouse) -> DataFrame:
    return A.yearly(db.monthly_tax, "sum")


@question("yearly_median", f"select yr, {MEDIANS_SQL} from monthly_tax group by yr",
          views="monthly_tax")
def yearly_median(db: Warehouse) -> DataFrame:
    return rounded(A.yearly(db.stored_facts, "median", stored=True), *MEASURES)


@question("monthly_sum", f"select yr, mon, {SUMS_SQL} from monthly_tax group by yr, mon",
          views="monthly_tax")
def monthly_sum(db: Warehouse) -> DataFrame:
    return A.monthly(db.monthly_tax, "sum")


@question("monthly_median", f"select yr, mon, {MEDIANS_SQL} from monthly_tax group by yr, mon",
          views="monthly_tax")
def monthly_median(db: Warehouse) -> DataFrame:
    return rounded(A.monthly(db.stored_facts, "median", stored=True), *MEASURES)


@question("yearly_by_type_with_total", f"""
    select yr, tax_type, {SUMS_SQL} from monthly_tax
    group by grouping sets ((yr), (yr, tax_type))""", views="monthly_tax")
def yearly_by_type_with_total(db: Warehouse) -> DataFrame:
    return A.by_type_with_total(db.monthly_tax)


@question("yearly_median_by_type_with_total", f"""
    select yr, tax_type, {MEDIANS_SQL} from monthly_tax
    group by grouping sets ((yr), (yr, tax_type))""", views="monthly_tax")
def yearly_median_by_type_with_total(db: Warehouse) -> DataFrame:
    return rounded(A.by_type_with_total(db.stored_facts, "median", stored=True), *MEASURES)


@question("yearly_growth_by_type", f"""
    select yr, tax_type, income, transactions, tax, {GROWTH_SQL}
    from (select yr, tax_type, {SUMS_SQL} from tax_all
          group by grouping sets ((yr), (yr, tax_type)))
    window w as (partition by tax_type order by yr)""", views="tax_all")
def yearly_growth_by_type(db: Warehouse) -> DataFrame:
    return A.yearly_growth(db.monthly_tax, db.predict)


@question("payer_count", "select count(*) as count from taxpayer", views="taxpayer")
def payer_count(db: Warehouse) -> DataFrame:
    return A.payer_count(db.taxpayer)


@question("distinct_years", "select distinct yr from monthly_tax order by yr", views="monthly_tax")
def distinct_years(db: Warehouse) -> DataFrame:
    return metadata.distinct_years(db.spark, db.facts_folder)


@question("max_year", "select max(yr) as max_year, max(yr) + 1 as next_year from monthly_tax",
          views="monthly_tax")
def max_year(db: Warehouse) -> DataFrame:
    return metadata.last_year(db.spark, db.facts_folder).withColumn("next_year", F.col("max_year") + 1)


YEARS_SQL = """
    select min(yr) as min_year, max(yr) as max_year,
      string_agg(cast(yr as string), ',' order by yr) as years
    from (select distinct yr from monthly_tax)"""


@question("year_range", YEARS_SQL, views="monthly_tax")
def year_range(db: Warehouse) -> DataFrame:
    return metadata.year_range(db.spark, db.facts_folder).withColumn("years", F.array_join("years", ","))


@question("latest_year_total", """
    select coalesce(cast(sum(income) as double), 0.0) as total from monthly_tax
    where yr = (select max(yr) from monthly_tax) and tax_type = '4-NOT SPECIFIED'""",
    views="monthly_tax")
def latest_year_total(db: Warehouse) -> DataFrame:
    return A.latest_year_total(db.monthly_tax, "income", "4-NOT SPECIFIED")


@question("payer_year_forecast", """
    select taxpayer_id, full_name, inn, yr, cast(sum(income) as double) as total_predicted_income,
      cast(sum(transactions) as bigint) as total_predicted_transactions,
      cast(sum(tax) as double) as total_predicted_tax
    from predict group by taxpayer_id, full_name, inn, yr""", views="predict")
def payer_year_forecast(db: Warehouse) -> DataFrame:
    sums = A.payer_year_summary(db.predict)
    return sums.withColumns({
        f"total_predicted_{m}": F.col(f"total_predicted_{m}").cast("double")
        for m in ("income", "tax")
    })


@question("month_profile_sum", f"select mon, {SUMS_SQL} from predict group by mon",
          views="predict")
def month_profile_sum(db: Warehouse) -> DataFrame:
    return A.month_profile(db.predict, "sum")


@question("month_profile_median", f"select mon, {MEDIANS_SQL} from predict group by mon",
          views="predict")
def month_profile_median(db: Warehouse) -> DataFrame:
    return rounded(A.month_profile(db.stored_predicted, "median", stored=True), *MEASURES)


@question("distinct_payers", """
    select distinct full_name, inn, taxpayer_type, activity_type, registration_district,
      has_employees, employees_count, tax_type
    from monthly_tax m join taxpayer t on m.taxpayer_id = t.taxpayer_id""",
    views="monthly_tax taxpayer")
def distinct_payers(db: Warehouse) -> DataFrame:
    return A.distinct_payers(J.payers_by_tax_type(db.monthly_tax, db.taxpayer))


METRICS_SQL = """
    round(avg(e), 3) as mae, round(sqrt(avg(e * e)), 3) as rmse, round(avg(e * e), 1) as mse,
    round(1 - sum(e * e) / (var_pop(y_test) * count(*)), 8) as r2,
    round(avg(case when y_test <> 0 then e / abs(y_test) end) * 100, 6) as mape,
    round(median(e), 4) as median_ae, round(max(e), 4) as max_error, count(*) as observations"""
METRIC_DIGITS = {
    "mae": 3, "rmse": 3, "mse": 1, "r2": 8, "mape": 6, "median_ae": 4, "max_error": 4,
}


def rounded_metrics(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, d) for c, d in METRIC_DIGITS.items()})


@question("regression_metrics", f"""
    select {METRICS_SQL} from (select *, abs(y_test - y_pred) as e from preds)""", views="preds")
def regression_metrics(db: Warehouse) -> DataFrame:
    return rounded_metrics(R.regression_metrics(db.preds, stored=True))


@question("regression_metrics_by_target", f"""
    select target, {METRICS_SQL} from (
      select 'gross' as target, y_test, abs(y_test - y_pred) as e from preds
      union all select 'net', y_pred, abs(y_pred - y_test) from preds) group by target""",
    views="preds")
def regression_metrics_by_target(db: Warehouse) -> DataFrame:
    sets = db.preds.select(F.lit("gross").alias("target"), "y_test", "y_pred").unionAll(
        db.preds.select(F.lit("net"), F.col("y_pred"), F.col("y_test"))
    )
    return rounded_metrics(R.regression_metrics(sets, by=["target"], stored=True))


@question("ideal_line_range", """
    select least(min(y_test), min(y_pred)) as min_val,
      greatest(max(y_test), max(y_pred)) as max_val from preds""", views="preds")
def ideal_line_range(db: Warehouse) -> DataFrame:
    return R.ideal_line(db.preds)


# ------------------------------------------------------------------ windows, sorts, pages


@question("growth_pct", f"""
    select yr, income, transactions, tax, {GROWTH_SQL}
    from (select yr, {SUMS_SQL} from monthly_tax group by yr)
    window w as (order by yr)""", views="monthly_tax")
def growth_pct(db: Warehouse) -> DataFrame:
    return A.growth(A.yearly(db.monthly_tax))


@question("page_with_total", """
    select taxpayer_id, full_name, inn, registration_district, has_employees, employees_count,
      count(*) over () as total_count
    from taxpayer order by full_name desc, taxpayer_id limit 25 offset 50""", views="taxpayer")
def page_with_total(db: Warehouse) -> DataFrame:
    payers = db.taxpayer.select(*L.SORTABLE)
    return L.with_total(L.page_of(L.order_by(payers, "full_name", "desc"), 3, 25), payers)


@question("sort_year_month", """
    select yr, mon, cast(income as double) as total_income, transactions as total_transactions,
      cast(tax as double) as total_tax
    from monthly_tax order by yr, mon""", views="monthly_tax")
def sort_year_month(db: Warehouse) -> DataFrame:
    rows = P.monthly_rows(db.monthly_tax)
    return rows.withColumns({c: F.col(c).cast("double") for c in ("total_income", "total_tax")})


@question("sort_dynamic", """
    select taxpayer_id, registration_district, employees_count from taxpayer
    order by employees_count desc nulls last, taxpayer_id""", views="taxpayer")
def sort_dynamic(db: Warehouse) -> DataFrame:
    rows = db.taxpayer.select("taxpayer_id", "registration_district", "employees_count")
    return L.order_by(rows, "employees_count", "desc")


@question("paginate", """
    select taxpayer_id, registration_district from taxpayer
    order by registration_district, taxpayer_id limit 20 offset 40""", views="taxpayer")
def paginate(db: Warehouse) -> DataFrame:
    rows = db.taxpayer.select("taxpayer_id", "registration_district")
    return L.page_of(L.order_by(rows, "registration_district"), 3, 20)


@question("paginate_after", """
    select taxpayer_id, full_name from taxpayer where taxpayer_id > 99
    order by taxpayer_id limit 30""", views="taxpayer")
def paginate_after(db: Warehouse) -> DataFrame:
    return L.page_after(db.taxpayer.select("taxpayer_id", "full_name"), 99, 30)


@question("sample_n", """
    select taxpayer_id, yr, mon, tax_type, cast(income as double) as income from monthly_tax
    order by md5(concat_ws('|', '42', taxpayer_id, yr, mon, tax_type)) limit 100""",
    views="monthly_tax")
def sample_n(db: Warehouse) -> DataFrame:
    keys = ["taxpayer_id", "yr", "mon", "tax_type"]
    rows = db.monthly_tax.select(*keys, F.col("income").cast("double").alias("income"))
    return R.sample_rows(rows, keys, 100, 42)


# ------------------------------------------------------------------ set operations


@question("union_real_predict", f"""
    select yr, mon, tax_type, {AS_DOUBLES_SQL} from monthly_tax
    union all select yr, mon, tax_type, {AS_DOUBLES_SQL} from predict""",
    views="monthly_tax predict")
def union_real_predict(db: Warehouse) -> DataFrame:
    names = ["yr", "mon", "tax_type", *MEASURES]
    both = db.monthly_tax.select(*names).unionByName(db.predict.select(*names))
    return as_doubles(both)


@question("concat_frames", f"""
    select yr, {SUMS_SQL} from tax_all group by yr""", views="tax_all")
def concat_frames(db: Warehouse) -> DataFrame:
    # Predicted rows for a recorded year lose to the recorded ones.
    predicted = db.predict.select("yr", *MEASURES).unionByName(
        db.monthly_tax.where("yr = 2000").select("yr", "income", F.lit(0).alias("transactions"), "tax")
    )
    return A.real_over_predicted(A.yearly(db.monthly_tax), A.yearly(predicted), ["yr"])


@question("distinct_rows", """
    select distinct yr, mon, tax_type from monthly_tax""", views="monthly_tax")
def distinct_rows(db: Warehouse) -> DataFrame:
    return db.monthly_tax.select("yr", "mon", "tax_type").distinct()
