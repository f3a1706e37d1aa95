"""Files and summary tables. Each run writes to a fresh folder and reads it back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiscus.operators import aggregates as A
from fiscus.operators import metrics as R
from fiscus.plans.catalogue import question
from fiscus.plans.relational import (
    AS_DOUBLES_SQL,
    GROWTH_SQL,
    MEDIANS_SQL,
    METRIC_DIGITS,
    METRICS_SQL,
    SUMS_SQL,
    as_doubles,
)
from fiscus.schemas import MONTHLY_MEDIAN, YEARLY_GROWTH
from fiscus.session import shared_folder
from fiscus.sources import csv_files, marts
from fiscus.sources.warehouse import Warehouse

MEDIAN_NAMES = ("income_median", "tax_median", "transactions_median")


@question("scan_econ_csv", """
    select yr, mon, core_cpi, cpi_yoy, cast(null as double) as reer, retail_sales,
      cast(null as double) as unemployment from econ""", views="econ")
def scan_econ_csv(db: Warehouse) -> DataFrame:
    path = shared_folder(db.spark, "econ-csv")
    csv_files.write_econ_csv(db.econ, path)
    return csv_files.read_econ_csv(db.spark, path)


@question("scan_predictions_csv", "select y_test, y_pred from preds", views="preds")
def scan_predictions_csv(db: Warehouse) -> DataFrame:
    path = shared_folder(db.spark, "predictions-csv")
    csv_files.write_csv(db.preds.select(F.col("y_test").alias("y_true"), "y_pred"), path)
    return csv_files.read_predictions_csv(db.spark, path)


@question("sink_csv", f"""
    select taxpayer_id, full_name, yr, mon, tax_type, {AS_DOUBLES_SQL} from predict""",
    views="predict")
def sink_csv(db: Warehouse) -> DataFrame:
    rows = as_doubles(db.predict).select(
        "taxpayer_id", "full_name", "yr", "mon", "tax_type", "income", "transactions", "tax"
    )
    path = shared_folder(db.spark, "forecast-csv")
    csv_files.write_csv(rows, path)
    return db.spark.read.schema(rows.schema).csv(path, header=True)


@question("merge_absent_monthly_median", f"""
    select yr, mon, tax_type, case when yr = 1997 then -1.0e0 else income end as income_median,
      case when yr = 1997 then -1.0e0 else tax end as tax_median,
      case when yr = 1997 then -1.0e0 else transactions end as transactions_median
    from (select yr, mon, tax_type, {MEDIANS_SQL} from tax_all
          group by grouping sets ((yr, mon), (yr, mon, tax_type)))""", views="tax_all")
def merge_absent_monthly_median(db: Warehouse) -> DataFrame:
    path = shared_folder(db.spark, "monthly-median")
    rows = marts.monthly_median_rows(db.monthly_tax, db.predict)
    # Rows already stored for 1997 must survive both merges as they are.
    stored = (
        db.monthly_tax.where("yr = 1997").rollup("yr", "mon", "tax_type").count()
        .where("mon is not null").withColumns({m: F.lit(-1.0) for m in MEDIAN_NAMES})
    )
    keys = marts.MEDIAN_KEYS
    marts.merge_absent(stored, path, MONTHLY_MEDIAN, keys)
    marts.merge_absent(rows, path, MONTHLY_MEDIAN, keys)
    merged = marts.merge_absent(rows, path, MONTHLY_MEDIAN, keys).drop("created_at")
    return merged.withColumns({m: F.round(m, 4) for m in MEDIAN_NAMES})


GROWTH_ROWS_SQL = f"""
    select yr, tax_type, income as income_total, tax as tax_total,
      cast(transactions as double) as transaction_total,
      coalesce(income_growth, 0) as income_growth, coalesce(tax_growth, 0) as tax_growth,
      coalesce(transactions_growth, 0) as transactions_growth
    from (select yr, tax_type, income, transactions, tax, {GROWTH_SQL}
      from (select yr, tax_type, {SUMS_SQL} from tax_all
            group by grouping sets ((yr), (yr, tax_type)))
      window w as (partition by tax_type order by yr))"""


@question("merge_absent_yearly_growth", f"""
    select * from ({GROWTH_ROWS_SQL})""", views="tax_all")
def merge_absent_yearly_growth(db: Warehouse) -> DataFrame:
    path = shared_folder(db.spark, "yearly-growth")
    rows = marts.yearly_growth_rows(db.monthly_tax, db.predict, "sum")
    marts.merge_absent(rows.where("tax_type is null"), path, YEARLY_GROWTH, marts.GROWTH_KEYS)
    marts.merge_absent(rows, path, YEARLY_GROWTH, marts.GROWTH_KEYS)
    return marts.merge_absent(rows, path, YEARLY_GROWTH, marts.GROWTH_KEYS)


@question("replace_year_predictions", """
    select taxpayer_id, full_name, inn, yr, mon, cast(income as double) as income, transactions,
      cast(tax as double) as tax, tax_type, cast(null as string) as taxpayer_type, activity_type,
      registration_district, has_employees, employees_count
    from predict
    union all
    select taxpayer_id, cast(null as string), cast(null as string), yr, mon,
      cast(income as double), transactions, cast(tax as double), tax_type, cast(null as string),
      cast(null as string), cast(null as string), cast(null as boolean), cast(null as int)
    from monthly_tax where yr = 2000""", views="monthly_tax predict")
def replace_year_predictions(db: Warehouse) -> DataFrame:
    path = shared_folder(db.spark, "predict")
    named = {"income": "predicted_income", "transactions": "predicted_transactions",
             "tax": "predicted_tax"}
    old = db.facts(2000, 2001).withColumnsRenamed(named)
    new = db.predict.drop("taxpayer_type").withColumnsRenamed(named)
    marts.replace_year(old, path)
    marts.replace_year(new, path)
    return marts.replace_year(new, path)


@question("append_model_metrics", f"""
    select m.*, model_name, target_name, 'test' as dataset_type, 'v1.0' as model_version,
      cast(null as string) as tax_type
    from (select {METRICS_SQL} from (select *, abs(y_test - y_pred) as e from preds)) m,
      (values ('GBT', 'Income'), ('Ridge', 'Tax')) v(model_name, target_name)""", views="preds")
def append_model_metrics(db: Warehouse) -> DataFrame:
    path = shared_folder(db.spark, "model-metrics")
    metrics = R.regression_metrics(db.preds, stored=True)
    marts.append_model_metrics(metrics, path, "GBT", "Income")
    stored = marts.append_model_metrics(metrics, path, "Ridge", "Tax").drop("created_at")
    return stored.withColumns({c: F.round(c, d) for c, d in METRIC_DIGITS.items()})


@question("lazy_mart", f"""
    select * from ({GROWTH_ROWS_SQL}) where tax_type = '2-HIGH' and yr between 1996 and 2001""",
    views="tax_all")
def lazy_mart(db: Warehouse) -> DataFrame:
    path = shared_folder(db.spark, "lazy-growth")

    def ask():
        return marts.summary_or_fill(
            db.spark, path, YEARLY_GROWTH, marts.GROWTH_KEYS,
            lambda: marts.yearly_growth_rows(db.monthly_tax, db.predict, "sum"),
            "2-HIGH", 1996, 2001,
        )

    ask()  # fills
    return ask()  # finds
