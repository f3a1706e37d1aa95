"""The questions users ask: one payer, lists of payers, yearly and monthly figures.

Questions about one payer also come in a batch form that answers for every payer at once,
keyed by INN.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiscus.operators import aggregates as A
from fiscus.operators import filters as P
from fiscus.operators import joins as J
from fiscus.operators import paging as L
from fiscus.operators.naming import as_totals, public
from fiscus.plans.catalogue import question
from fiscus.plans.relational import (
    GROWTH_SQL,
    HISTORY_SQL,
    MEDIANS_SQL,
    ONE_INN,
    SUMS_SQL,
    YEARS_SQL,
    as_doubles,
    rounded,
)
from fiscus.plans.storage import GROWTH_ROWS_SQL
from fiscus.schemas import MEASURES, YEARLY_GROWTH
from fiscus.session import shared_folder
from fiscus.sources import marts, metadata
from fiscus.sources.warehouse import Warehouse

GROWTH_NAMES = [f"{m}_growth" for m in MEASURES]
HISTORY_VIEWS = "monthly_tax taxpayer predict"


def history(db: Warehouse, inn: str | None = None) -> DataFrame:
    own = db if inn is None else db.of_payer(inn)
    return J.payer_history(own.monthly_tax, own.predict, own.taxpayer, inn)


@question("q_payer", f"select * from taxpayer where inn = '{ONE_INN}'", views="taxpayer")
def q_payer(db: Warehouse) -> DataFrame:
    return P.payer_by_inn(db.stored_payers, ONE_INN)


MONTHS_SQL = f"""
    select inn, yr as "Year", mon as "Month", cast(income as double) as "TotalIncome",
      transactions as "TotalTransactions", cast(tax as double) as "TotalTax"
    from ({HISTORY_SQL})"""


def months(rows: DataFrame) -> DataFrame:
    """Month order; the payer and regime only make the sort keys finer."""
    ordered = rows.orderBy("yr", "mon", "inn", "tax_type").drop("tax_type")
    return public(as_totals(as_doubles(ordered)))


@question("q_monthly_history", f"""
    select * exclude (inn) from ({MONTHS_SQL}) where inn = '{ONE_INN}'""", views=HISTORY_VIEWS)
def q_monthly_history(db: Warehouse) -> DataFrame:
    return months(history(db, ONE_INN)).drop("inn")


@question("q_monthly_history_all", MONTHS_SQL, views=HISTORY_VIEWS)
def q_monthly_history_all(db: Warehouse) -> DataFrame:
    return months(history(db))


def payer_years_sql(figures: str) -> str:
    return f"""
    select inn, yr as "Year", income as "Income", transactions as "Transactions", tax as "Tax"
    from (select inn, yr, {figures} from ({HISTORY_SQL}) group by inn, yr)"""


@question("q_yearly_totals", f"""
    select * exclude (inn) from ({payer_years_sql(SUMS_SQL)}) where inn = '{ONE_INN}'""",
    views=HISTORY_VIEWS)
def q_yearly_totals(db: Warehouse) -> DataFrame:
    return public(A.yearly_by_payer(history(db, ONE_INN))).drop("inn")


@question("q_yearly_totals_all", payer_years_sql(SUMS_SQL), views=HISTORY_VIEWS)
def q_yearly_totals_all(db: Warehouse) -> DataFrame:
    return public(A.yearly_by_payer(history(db)))


@question("q_yearly_median_inn", f"""
    select * exclude (inn) from ({payer_years_sql(MEDIANS_SQL)}) where inn = '{ONE_INN}'""",
    views=HISTORY_VIEWS)
def q_yearly_median_inn(db: Warehouse) -> DataFrame:
    medians = A.yearly_by_payer(history(db, ONE_INN), "median")
    return public(rounded(medians, *MEASURES)).drop("inn")


@question("q_yearly_median_all", payer_years_sql(MEDIANS_SQL), views=HISTORY_VIEWS)
def q_yearly_median_all(db: Warehouse) -> DataFrame:
    return public(rounded(A.yearly_by_payer(history(db), "median"), *MEASURES))


def growth_sql(source: str, window: str, digits: int = 6) -> str:
    names = ", ".join(f"round({n}, {digits}) as {n}" for n in GROWTH_NAMES)
    return f"""select * replace ({names}) from
      (select *, {GROWTH_SQL} from ({source}) window w as ({window}))"""


PAYER_GROWTH_SQL = f"""
    select inn, yr as "Year", income as "Income", transactions as "Transactions", tax as "Tax",
      income_growth as "IncomeGrowth_%", transactions_growth as "TransactionsGrowth_%",
      tax_growth as "TaxGrowth_%"
    from ({growth_sql(f"select inn, yr, {MEDIANS_SQL} from ({HISTORY_SQL}) group by inn, yr",
                      "partition by inn order by yr")})"""


def payer_growth(db: Warehouse, inn: str | None = None) -> DataFrame:
    medians = rounded(A.yearly_by_payer(history(db, inn), "median"), *MEASURES)
    return public(rounded(A.growth(medians, by=["inn"]), *GROWTH_NAMES, digits=6))


@question("q_yearly_growth_inn", f"""
    select * exclude (inn) from ({PAYER_GROWTH_SQL}) where inn = '{ONE_INN}'""",
    views=HISTORY_VIEWS)
def q_yearly_growth_inn(db: Warehouse) -> DataFrame:
    return payer_growth(db, ONE_INN).drop("inn")


@question("q_yearly_growth_all", PAYER_GROWTH_SQL, views=HISTORY_VIEWS)
def q_yearly_growth_all(db: Warehouse) -> DataFrame:
    return payer_growth(db)


MONTHLY_MEDIAN_SQL = f"""
    select yr as "Year", mon as "Month", tax_type as "TaxType", income as "Income",
      transactions as "Transactions", tax as "Tax"
    from (select yr, mon, tax_type, {MEDIANS_SQL} from tax_all
          group by grouping sets ((yr, mon), (yr, mon, tax_type)))"""


def monthly_median(db: Warehouse, *wanted) -> DataFrame:
    path = shared_folder(db.spark, "monthly-median")
    rows = marts.monthly_median_summary(db.stored_facts, db.stored_predicted, path, *wanted, stored=True)
    return public(rounded(rows.drop("created_at"), *MEASURES))


@question("q_monthly_median", f"""
    select * from ({MONTHLY_MEDIAN_SQL}) where "TaxType" is null""", views="tax_all")
def q_monthly_median(db: Warehouse) -> DataFrame:
    return monthly_median(db)


@question("q_monthly_median_type", f"""
    select * from ({MONTHLY_MEDIAN_SQL})
    where "TaxType" = '3-MEDIUM' and "Year" between 1997 and 2001""", views="tax_all")
def q_monthly_median_type(db: Warehouse) -> DataFrame:
    return monthly_median(db, "3-MEDIUM", 1997, 2001)


MONTHLY_GENERAL_SQL = """
    select yr as "Year", mon as "Month", cast(sum(income) as double) as "TotalIncome",
      cast(sum(transactions) as bigint) as "TotalTransactions",
      cast(sum(tax) as double) as "TotalTax"
    from monthly_tax"""


def monthly_general(db: Warehouse, tax_type=None, start_year=None, end_year=None) -> DataFrame:
    facts = db.recorded(start_year, end_year)
    rows = P.in_years(P.of_tax_type(facts, tax_type), start_year, end_year)
    return public(as_totals(A.monthly(rows)).orderBy("yr", "mon"))


@question("q_monthly_general", MONTHLY_GENERAL_SQL + " group by yr, mon order by yr, mon",
          views="monthly_tax")
def q_monthly_general(db: Warehouse) -> DataFrame:
    return monthly_general(db)


@question("q_monthly_general_type", MONTHLY_GENERAL_SQL + """
    where tax_type = '1-URGENT' and yr between 1996 and 1998 group by yr, mon order by yr, mon""",
    views="monthly_tax")
def q_monthly_general_type(db: Warehouse) -> DataFrame:
    return monthly_general(db, "1-URGENT", 1996, 1998)


def growth_names_sql(rows: str) -> str:
    return f"""
    select yr as "Year", tax_type as "TaxType", income_total as "Income", tax_total as "Tax",
      transaction_total as "Transactions", income_growth as "IncomeGrowth_%",
      tax_growth as "TaxGrowth_%", transactions_growth as "TransactionsGrowth_%"
    from ({rows})"""


def growth_of(db: Warehouse, mode: str, *wanted) -> DataFrame:
    path = shared_folder(db.spark, f"growth-{mode}")
    return marts.growth_summary(db.stored_facts, db.stored_predicted, path, mode, *wanted, stored=True)


@question("q_growth_general", f"""
    select * from ({growth_names_sql(GROWTH_ROWS_SQL)}) where "TaxType" is null""",
    views="tax_all")
def q_growth_general(db: Warehouse) -> DataFrame:
    return public(growth_of(db, "sum"))


@question("q_growth_general_type", f"""
    select * from ({growth_names_sql(GROWTH_ROWS_SQL)})
    where "TaxType" = '4-NOT SPECIFIED' and "Year" >= 1998""", views="tax_all")
def q_growth_general_type(db: Warehouse) -> DataFrame:
    return public(growth_of(db, "sum", "4-NOT SPECIFIED", 1998))


MEDIAN_GROWTH_ROWS_SQL = f"""
    select yr, tax_type, income as income_total, tax as tax_total,
      transactions as transaction_total, coalesce(income_growth, 0) as income_growth,
      coalesce(tax_growth, 0) as tax_growth,
      coalesce(transactions_growth, 0) as transactions_growth
    from ({growth_sql('''select yr, tax_type, median(cast(income as double)) as income,
        median(cast(transactions as double)) as transactions,
        median(cast(tax as double)) as tax
      from tax_all group by grouping sets ((yr), (yr, tax_type))''',
      "partition by tax_type order by yr")})"""


def median_growth(db: Warehouse, *wanted) -> DataFrame:
    rows = growth_of(db, "median", *wanted)
    return public(rounded(rounded(rows, *MEASURES), *GROWTH_NAMES, digits=6))


MEDIAN_GROWTH_SQL = f"""
    select * replace (round("Income", 4) as "Income", round("Tax", 4) as "Tax",
      round("Transactions", 4) as "Transactions")
    from ({growth_names_sql(MEDIAN_GROWTH_ROWS_SQL)})"""


@question("q_growth_median", f"""{MEDIAN_GROWTH_SQL} where "TaxType" is null""", views="tax_all")
def q_growth_median(db: Warehouse) -> DataFrame:
    return median_growth(db)


@question("q_growth_median_type", f"""{MEDIAN_GROWTH_SQL}
    where "TaxType" = '5-LOW' and "Year" between 1996 and 2000""", views="tax_all")
def q_growth_median_type(db: Warehouse) -> DataFrame:
    return median_growth(db, "5-LOW", 1996, 2000)


@question("growth_marts_together", f"""
    select 'yearly_growth_general' as mart, * from ({GROWTH_ROWS_SQL})
    union all
    select 'yearly_growth_median', * replace (round(income_total, 4) as income_total, round(tax_total, 4) as tax_total,
      round(transaction_total, 4) as transaction_total, round(income_growth, 4) as income_growth,
      round(tax_growth, 4) as tax_growth, round(transactions_growth, 4) as transactions_growth)
    from ({MEDIAN_GROWTH_ROWS_SQL})""", views="tax_all")
def growth_marts_together(db: Warehouse) -> DataFrame:
    path = shared_folder(db.spark, "growth-marts")
    marts.fill_growth_marts(db.stored_facts, db.stored_predicted, path, stored=True)
    # The second fill finds every key and commits nothing.
    both = marts.fill_growth_marts(db.stored_facts, db.stored_predicted, path, stored=True)
    sums, medians = (
        both.read(name, YEARLY_GROWTH).select(F.lit(name).alias("mart"), "*") for name in marts.GROWTH_MARTS
    )
    return sums.unionByName(rounded(medians, *[n for n in YEARLY_GROWTH.names if n not in marts.GROWTH_KEYS]))


@question("q_predict_profile", """
    select mon as "Month", cast(sum(income) as double) as "TotalIncome",
      cast(sum(transactions) as bigint) as "TotalTransactions",
      cast(sum(tax) as double) as "TotalTax",
      round(median(cast(income as double)), 4) as "MedianIncome",
      round(median(cast(transactions as double)), 4) as "MedianTransactions",
      round(median(cast(tax as double)), 4) as "MedianTax"
    from predict group by mon""", views="predict")
def q_predict_profile(db: Warehouse) -> DataFrame:
    predictions = db.stored_predicted
    sums = public(as_totals(A.month_profile(predictions)))
    medians = A.month_profile(predictions, "median", stored=True)
    medians = rounded(medians, *MEASURES).withColumnsRenamed({
        "mon": "Month", "income": "MedianIncome", "transactions": "MedianTransactions",
        "tax": "MedianTax",
    })
    return sums.join(medians, "Month")


@question("q_payer_count", """
    select count(*) as count from taxpayer where taxpayer_type = 'BUILDING'""", views="taxpayer")
def q_payer_count(db: Warehouse) -> DataFrame:
    return A.payer_count(db.taxpayer, "BUILDING")


@question("q_year_range", YEARS_SQL, views="monthly_tax")
def q_year_range(db: Warehouse) -> DataFrame:
    return metadata.year_range(db.spark, db.facts_folder).withColumn("years", F.array_join("years", ","))


PAGE_SQL = """
    select taxpayer_id as id, full_name as name, inn, registration_district, has_employees,
      nullif(employees_count, 0) as employees_count, count(*) over () as total,
      cast(ceil(count(*) over () / 15.0) as bigint) as total_pages
    from taxpayer"""


# The list shows this many payers at most, whatever is asked for.
MAX_PAGE_SIZE = 100


def page(db: Warehouse, page_size: int = 15, **wanted) -> DataFrame:
    rows = L.payer_page(db.taxpayer, page_size=min(page_size, MAX_PAGE_SIZE), **wanted)
    cards = P.user_records(P.normalize_types(rows), "total_count", "total_pages")
    return cards.drop("avatar").withColumnRenamed("total_count", "total")


@question("q_payers_page", PAGE_SQL + """
    where inn like '%1%' and registration_district = 'NATION_5'
    order by employees_count desc nulls last, taxpayer_id limit 15 offset 0""", views="taxpayer")
def q_payers_page(db: Warehouse) -> DataFrame:
    return page(db, page=1, inn="1", district="NATION_5", sort_by="employees_count", sort_order="desc")


@question("q_payers_page_deep", PAGE_SQL + """
    order by full_name, taxpayer_id limit 15 offset 45""", views="taxpayer")
def q_payers_page_deep(db: Warehouse) -> DataFrame:
    return page(db, page=4, sort_by="full_name")


@question("q_payers_page_after", """
    select taxpayer_id, full_name, registration_district from taxpayer
    where registration_district > 'NATION_13'
      or (registration_district = 'NATION_13' and taxpayer_id > 20)
    order by registration_district, taxpayer_id limit 15""", views="taxpayer")
def q_payers_page_after(db: Warehouse) -> DataFrame:
    rows = db.taxpayer.select("taxpayer_id", "full_name", "registration_district")
    return L.page_after(rows, 20, 15, "registration_district", "asc", "NATION_13")


@question("q_payers_page_summary", """
    select count(*) as total, cast(ceil(count(*) / 15.0) as bigint) as total_pages
    from taxpayer where inn like '%1%' and registration_district = 'NATION_5'""",
    views="taxpayer")
def q_payers_page_summary(db: Warehouse) -> DataFrame:
    return L.page_summary(db.taxpayer, 15, "1", "NATION_5")


@question("q_payer_profile", f"""
    select taxpayer_id as id, full_name as name, inn, registration_district, has_employees,
      nullif(employees_count, 0) as employees_count,
      concat('https://api.dicebear.com/7.x/initials/svg?seed=', full_name) as avatar_src
    from taxpayer where inn = '{ONE_INN}'""", views="taxpayer")
def q_payer_profile(db: Warehouse) -> DataFrame:
    cards = P.user_records(P.normalize_types(P.profile_by_inn(db.stored_payers, ONE_INN)))
    return cards.select("*", F.col("avatar.src").alias("avatar_src")).drop("avatar")
