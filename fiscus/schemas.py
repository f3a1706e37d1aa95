"""Column layouts of the logical tables, and the names shared by all operators."""

from __future__ import annotations

from pyspark.sql import types as T

MEASURES = ("income", "transactions", "tax")

TAXPAYER = T.StructType([
    T.StructField("taxpayer_id", T.LongType()),
    T.StructField("full_name", T.StringType()),
    T.StructField("passport_number", T.StringType()),
    T.StructField("inn", T.StringType()),
    T.StructField("taxpayer_type", T.StringType()),
    T.StructField("activity_type", T.StringType()),
    T.StructField("registration_district", T.StringType()),
    T.StructField("has_employees", T.BooleanType()),
    T.StructField("employees_count", T.IntegerType()),
])

# One row per payer, month and tax regime.
MONTHLY_TAX = T.StructType([
    T.StructField("taxpayer_id", T.LongType()),
    T.StructField("yr", T.IntegerType()),
    T.StructField("mon", T.IntegerType()),
    T.StructField("tax_type", T.StringType()),
    T.StructField("income", T.DecimalType(18, 2)),
    T.StructField("tax", T.DecimalType(18, 2)),
    T.StructField("transactions", T.LongType()),
])

PREDICT = T.StructType([
    T.StructField("taxpayer_id", T.LongType()),
    T.StructField("full_name", T.StringType()),
    T.StructField("inn", T.StringType()),
    T.StructField("yr", T.IntegerType()),
    T.StructField("mon", T.IntegerType()),
    T.StructField("income", T.DoubleType()),
    T.StructField("transactions", T.LongType()),
    T.StructField("tax", T.DoubleType()),
    T.StructField("tax_type", T.StringType()),
    T.StructField("taxpayer_type", T.StringType()),
    T.StructField("activity_type", T.StringType()),
    T.StructField("registration_district", T.StringType()),
    T.StructField("has_employees", T.BooleanType()),
    T.StructField("employees_count", T.IntegerType()),
])

# A null tax_type is the row for all regimes together.
YEARLY_GROWTH = T.StructType([
    T.StructField("yr", T.IntegerType()),
    T.StructField("tax_type", T.StringType()),
    T.StructField("income_total", T.DoubleType()),
    T.StructField("tax_total", T.DoubleType()),
    T.StructField("transaction_total", T.DoubleType()),
    T.StructField("income_growth", T.DoubleType()),
    T.StructField("tax_growth", T.DoubleType()),
    T.StructField("transactions_growth", T.DoubleType()),
])

MONTHLY_MEDIAN = T.StructType([
    T.StructField("yr", T.IntegerType()),
    T.StructField("mon", T.IntegerType()),
    T.StructField("tax_type", T.StringType()),
    T.StructField("income_median", T.DoubleType()),
    T.StructField("tax_median", T.DoubleType()),
    T.StructField("transactions_median", T.DoubleType()),
    T.StructField("created_at", T.TimestampType()),
])

MEDIAN_SKETCHES = T.StructType([
    T.StructField("yr", T.IntegerType()),
    T.StructField("mon", T.IntegerType()),
    T.StructField("tax_type", T.StringType()),
    T.StructField("income", T.BinaryType()),
    T.StructField("transactions", T.BinaryType()),
    T.StructField("tax", T.BinaryType()),
])

MODEL_METRICS = T.StructType([
    T.StructField("model_name", T.StringType()),
    T.StructField("target_name", T.StringType()),
    T.StructField("dataset_type", T.StringType()),
    T.StructField("mae", T.DoubleType()),
    T.StructField("rmse", T.DoubleType()),
    T.StructField("mse", T.DoubleType()),
    T.StructField("r2", T.DoubleType()),
    T.StructField("mape", T.DoubleType()),
    T.StructField("median_ae", T.DoubleType()),
    T.StructField("max_error", T.DoubleType()),
    T.StructField("observations", T.LongType()),
    T.StructField("model_version", T.StringType()),
    T.StructField("tax_type", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
])

ECON_INDICATORS = ("core_cpi", "cpi_yoy", "reer", "retail_sales", "unemployment")

# Positional: the file's own headers hold commas, dots and brackets.
ECON_CSV = T.StructType(
    [T.StructField("time", T.StringType())]
    + [T.StructField(name, T.DoubleType()) for name in ECON_INDICATORS]
)

PREDICTIONS_CSV = T.StructType([
    T.StructField("y_test", T.DoubleType()),
    T.StructField("y_pred", T.DoubleType()),
])

TAX_OBJECT = T.StructType([
    T.StructField("taxpayer_id", T.LongType()),
    T.StructField("object_type", T.StringType()),
    T.StructField("description_tax", T.StringType()),
    T.StructField("taxable_base", T.DoubleType()),
    T.StructField("acquisition_date", T.DateType()),
])
