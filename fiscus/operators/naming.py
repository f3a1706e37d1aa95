"""Public column names of the answers, as the users of the dashboards know them."""

from __future__ import annotations

from pyspark.sql import DataFrame

PUBLIC = {
    "yr": "Year",
    "mon": "Month",
    "tax_type": "TaxType",
    "income": "Income",
    "transactions": "Transactions",
    "tax": "Tax",
    "total_income": "TotalIncome",
    "total_transactions": "TotalTransactions",
    "total_tax": "TotalTax",
    "income_growth": "IncomeGrowth_%",
    "transactions_growth": "TransactionsGrowth_%",
    "tax_growth": "TaxGrowth_%",
}

TOTALS = {
    "income": "total_income",
    "transactions": "total_transactions",
    "tax": "total_tax",
}

GROWTH_MART = {
    "income_total": "income",
    "tax_total": "tax",
    "transaction_total": "transactions",
}

MEDIAN_MART = {
    "income_median": "income",
    "tax_median": "tax",
    "transactions_median": "transactions",
}

PREDICTED = {
    "predicted_income": "income",
    "predicted_transactions": "transactions",
    "predicted_tax": "tax",
}


def public(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in PUBLIC.items() if k in df.columns})


def as_totals(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed(TOTALS)
