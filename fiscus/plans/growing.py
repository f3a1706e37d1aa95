"""Tables that grow with the data instead of being made anew: marts by year, sketches, ranked pages;
and interval joins on dates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiscus.functions import lookups as K
from fiscus.operators import filters as P
from fiscus.operators import intervals as I
from fiscus.operators import rules as G
from fiscus.operators import sketches as S
from fiscus.plans.catalogue import question
from fiscus.plans.dashboard import MEDIAN_GROWTH_ROWS_SQL, PAGE_SQL
from fiscus.plans.relational import MEDIANS_SQL, rounded
from fiscus.plans.storage import GROWTH_ROWS_SQL, MEDIAN_NAMES
from fiscus.schemas import MEASURES, MONTHLY_MEDIAN, YEARLY_GROWTH
from fiscus.session import shared_folder
from fiscus.sources import marts, metadata
from fiscus.sources.commits import Tables
from fiscus.sources.warehouse import Warehouse

#: The marts below are filled up to this year first, and then with the years after it.
FIRST_YEARS = 1997


def in_two_steps(db: Warehouse, label: str, fill) -> Tables:
    """A mart that is filled, then grows by the years it lacks, and then lacks nothing."""
    kept = Tables(db.spark, shared_folder(db.spark, label))
    years = sorted({*metadata.stored_years(db.spark, db.facts_folder), *metadata.stored_years(db.spark, db.predicted_folder)})
    fill(kept, [y for y in years if y <= FIRST_YEARS])
    fill(kept, years)
    if fill(kept, years):
        raise RuntimeError("a year that is stored was worked out again")
    return kept


@question("growth_by_added_years", f"select * from ({GROWTH_ROWS_SQL})", views="tax_all")
def growth_by_added_years(db: Warehouse) -> DataFrame:
    kept = in_two_steps(db, "growing-sums", lambda kept, years: marts.fill_growth_years(
        kept, db.stored_facts, db.stored_predicted, years, "sum", stored=True))
    return kept.read("yearly_growth_general", YEARLY_GROWTH)


@question("median_growth_by_added_years", f"""
    select * replace (round(income_total, 4) as income_total, round(tax_total, 4) as tax_total,
      round(transaction_total, 4) as transaction_total, round(income_growth, 4) as income_growth,
      round(tax_growth, 4) as tax_growth, round(transactions_growth, 4) as transactions_growth)
    from ({MEDIAN_GROWTH_ROWS_SQL})""", views="tax_all")
def median_growth_by_added_years(db: Warehouse) -> DataFrame:
    kept = in_two_steps(db, "growing-medians", lambda kept, years: marts.fill_growth_years(
        kept, db.stored_facts, db.stored_predicted, years, "median", stored=True))
    rows = kept.read("yearly_growth_median", YEARLY_GROWTH)
    return rounded(rows, *[n for n in YEARLY_GROWTH.names if n not in marts.GROWTH_KEYS])


@question("monthly_median_by_added_years", f"""
    select yr, mon, tax_type, income as income_median, tax as tax_median, transactions as transactions_median
    from (select yr, mon, tax_type, {MEDIANS_SQL} from tax_all
          group by grouping sets ((yr, mon), (yr, mon, tax_type)))""", views="tax_all")
def monthly_median_by_added_years(db: Warehouse) -> DataFrame:
    kept = in_two_steps(db, "growing-months", lambda kept, years: marts.fill_median_years(
        kept, db.stored_facts, db.stored_predicted, years, stored=True))
    rows = kept.read("monthly_median", MONTHLY_MEDIAN).drop("created_at")
    return rows.withColumns({m: F.round(m, 4) for m in MEDIAN_NAMES})


#: A single rank is within the published error in 99 of 100 cases, and within twice that practically always.
SLACK = 2


def near_the_middle(facts: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Whether the exact ranks of approximate medians are within the bound of the sketch."""
    both = facts.select(*[F.col(k).alias(f"fact_{k}") for k in keys], *[F.col(m).cast("double").alias(f"fact_{m}") for m in MEASURES])
    # A null regime stands for all of them, so facts are counted for both.
    both = both.withColumn("fact_tax_type", F.explode(F.array("fact_tax_type", F.lit(None))))
    match = F.lit(True)
    for k in keys:
        match = match & F.col(f"fact_{k}").eqNullSafe(F.col(k))
    ranks = both.join(found, match).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.max(f"n_{m}").alias(f"n_{m}") for m in MEASURES],
        *[F.count_if(F.col(f"fact_{m}") < F.col(m)).alias(f"below_{m}") for m in MEASURES],
        *[F.count_if(F.col(f"fact_{m}") <= F.col(m)).alias(f"upto_{m}") for m in MEASURES],
    )
    # Ranks are whole: half a row is the least they can be off.
    slack = SLACK * S.rank_error() * F.col("n") + 0.5
    return ranks.select(*keys, "n", *[
        ((F.col(f"n_{m}") == F.col("n")) & (F.col(f"below_{m}") - slack <= F.col("n") / 2) & (F.col(f"upto_{m}") + slack >= F.col("n") / 2))
        .alias(f"{m}_near") for m in MEASURES
    ])


SKETCH_SQL = "count(*) as n, true as income_near, true as transactions_near, true as tax_near"


def sketch_mart(db: Warehouse) -> Tables:
    return in_two_steps(db, "sketches", lambda kept, years: marts.fill_sketch_years(
        kept, db.stored_facts, db.stored_predicted, years))


@question("yearly_median_sketched", f"""
    select yr, tax_type, {SKETCH_SQL} from tax_all group by grouping sets ((yr), (yr, tax_type))""", views="tax_all")
def yearly_median_sketched(db: Warehouse) -> DataFrame:
    found = marts.sketched_medians(sketch_mart(db), ["yr"])
    return near_the_middle(db.stored_facts.unionByName(db.stored_predicted), found, ["yr", "tax_type"])


@question("month_profile_sketched", f"""
    select mon, tax_type, {SKETCH_SQL} from tax_all group by grouping sets ((mon), (mon, tax_type))""", views="tax_all")
def month_profile_sketched(db: Warehouse) -> DataFrame:
    found = marts.sketched_medians(sketch_mart(db), ["mon"])
    return near_the_middle(db.stored_facts.unionByName(db.stored_predicted), found, ["mon", "tax_type"])


@question("q_payers_page_ranked", PAGE_SQL + """
    order by registration_district desc nulls last, taxpayer_id limit 15 offset 90""", views="taxpayer")
def q_payers_page_ranked(db: Warehouse) -> DataFrame:
    rows = db.payer_page(7, 15, "registration_district", "desc")
    cards = P.user_records(P.normalize_types(rows), "total_count", "total_pages")
    return cards.drop("avatar").withColumnRenamed("total_count", "total")


DATE_COLUMNS = "band, date_from, date_to, low, high"
#: Overlapping, with a gap in 1996 and no end of the last one.
DATE_BANDS = [
    (0, "1993-03-01", "1994-02-28", 10000, 30000), (1, "1994-01-15", "1996-01-31", 55000, 60000),
    (2, "1995-06-01", "1995-06-30", 45000, 50000), (3, "1997-01-01", None, 70000, 90000),
]


@question("price_band_by_date", f"""
    with b as ({K.values_sql(DATE_COLUMNS, DATE_BANDS)}),
    days as (select day, min_by(low, band) as low, min_by(high, band) as high
      from (select distinct cast(l_shipdate as date) as day from lineitem) join b
        on day >= cast(date_from as date) and day <= coalesce(cast(date_to as date), date '9999-12-31')
      group by day)
    select o_custkey as taxpayer_id, l_returnflag as object_type, count(*) as n_objects,
      cast(sum(coalesce(low, 60000)) as bigint) as low_total, cast(sum(coalesce(high, 60000)) as bigint) as high_total
    from lineitem join orders on l_orderkey = o_orderkey left join days on day = cast(l_shipdate as date)
    group by 1, 2""")
def price_band_by_date(db: Warehouse) -> DataFrame:
    bands = K.values_table(db.spark, DATE_COLUMNS, DATE_BANDS)
    rows = G.with_price_band_at(db.tax_objects, bands, "acquisition_date", "date_from", "date_to")
    return rows.groupBy("taxpayer_id", "object_type").agg(
        F.count(F.lit(1)).alias("n_objects"), F.sum("low").cast("long").alias("low_total"),
        F.sum("high").cast("long").alias("high_total"),
    )


#: Days an agreement, made by an order, lasts after the first one.
AGREED_DAYS = 400


@question("agreement_in_force", f"""
    with a as (select o_custkey as taxpayer_id, o_orderkey as agreement, cast(o_orderdate as date) as day_from,
        cast(o_orderdate as date) + {AGREED_DAYS} as day_to, o_orderpriority as terms from orders),
    days as (select distinct o_custkey as taxpayer_id, cast(l_shipdate as date) as day
      from lineitem join orders on l_orderkey = o_orderkey),
    held as (select d.taxpayer_id, day, min(agreement) as agreement, min_by(terms, agreement) as terms
      from days d join a on d.taxpayer_id = a.taxpayer_id and day between day_from and day_to group by 1, 2)
    select o_custkey as taxpayer_id, l_orderkey, l_linenumber, cast(l_shipdate as date) as acquisition_date, agreement, terms
    from lineitem join orders on l_orderkey = o_orderkey
    left join held on held.taxpayer_id = o_custkey and day = cast(l_shipdate as date)""")
def agreement_in_force(db: Warehouse) -> DataFrame:
    orders = db.base("orders")
    made = F.to_date("o_orderdate")
    agreements = orders.select(
        F.col("o_custkey").alias("taxpayer_id"), F.col("o_orderkey").alias("agreement"), made.alias("day_from"),
        F.date_add(made, AGREED_DAYS).alias("day_to"), F.col("o_orderpriority").alias("terms"),
    )
    lines = db.base("lineitem").select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("acquisition_date"))
    objects = lines.join(orders.select("o_orderkey", F.col("o_custkey").alias("taxpayer_id")), F.col("l_orderkey") == F.col("o_orderkey"))
    return I.with_interval(
        objects.drop("o_orderkey"), agreements, "acquisition_date", "day_from", "day_to", "agreement", ["agreement", "terms"], ["taxpayer_id"]
    )
