"""Scoring the months of a coming year, and keeping the stored forecast current."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiscus.functions.lookups import ECON_SCENARIO
from fiscus.functions.scalars import clip_low, round_half_even, season
from fiscus.operators.aggregates import last_year, payer_year_summary
from fiscus.operators.joins import (
    PAYER_ATTRIBUTES,
    attach_scenario,
    forecast_grid,
    payers_by_tax_type,
    spread,
)
from fiscus.schemas import MEASURES, PREDICT
from fiscus.sources import marts

FORECAST = (*PAYER_ATTRIBUTES, "tax_type", "yr", "mon", "season")
PREDICTED = tuple(f"predicted_{m}" for m in MEASURES)


def tidy(scored: DataFrame) -> DataFrame:
    """No negative predictions; money in cents and whole transactions, half to even."""
    money = {
        c: round_half_even(clip_low(F.col(c), 0.0), 2)
        for c in ("predicted_income", "predicted_tax")
    }
    count = round_half_even(clip_low(F.col("predicted_transactions"), 0.0), 0).cast("long")
    return scored.withColumns({**money, "predicted_transactions": count})


def score_grid(model: PipelineModel, payers: DataFrame, year: int) -> DataFrame:
    """Twelve predicted months for each payer and regime.

    Payers are spread over all cores; then rows are unfolded, encoded and scored where they are.
    """
    return tidy(model.transform(forecast_grid(payers, year))).select(*FORECAST, *PREDICTED)


def yearly_forecast(monthly: DataFrame) -> DataFrame:
    named = {f"predicted_{m}": m for m in MEASURES}
    return payer_year_summary(monthly.withColumnsRenamed(named))


def next_year(facts: DataFrame) -> int | None:
    """The year after the last recorded one; a single number."""
    year = last_year(facts).first()["max_year"]
    return None if year is None else year + 1


def payers_with_own_year(facts: DataFrame, payers: DataFrame) -> DataFrame:
    """Payer, regime and the year after the payer's own last recorded one."""
    seen = facts.groupBy("taxpayer_id").agg(
        F.collect_set("tax_type").alias("regimes"), (F.max("yr") + 1).alias("yr")
    )
    return payers.select(*PAYER_ATTRIBUTES).join(seen, "taxpayer_id").select(
        *PAYER_ATTRIBUTES, F.explode("regimes").alias("tax_type"), "yr"
    )


def score_payers(
    model: PipelineModel, facts: DataFrame, payers: DataFrame, inn: str | None = None
) -> DataFrame:
    """Each payer's next year, after the payer's own last recorded year.

    The regimes come from the payer's facts. For one payer the facts are first cut to the
    id, as in ``payer_history``.
    """
    if inn is not None:
        payers = payers.where(F.col("inn") == F.lit(inn))
        ids = payers.agg(F.min("taxpayer_id").alias("lo"), F.max("taxpayer_id").alias("hi"))
        facts = facts.where(F.col("taxpayer_id") >= ids.select("lo").scalar())
        facts = facts.where(F.col("taxpayer_id") <= ids.select("hi").scalar())
    grid = spread(payers_with_own_year(facts, payers)).select(
        "*", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("mon")
    )
    grid = grid.withColumn("season", season(F.col("mon")))
    return tidy(model.transform(grid)).select(*FORECAST, *PREDICTED)


def score_chained(
    income: PipelineModel,
    transactions: PipelineModel,
    tax: PipelineModel,
    payers: DataFrame,
    year: int,
    scenario: Mapping[str, float] = ECON_SCENARIO,
) -> DataFrame:
    """Predicted income feeds the transactions model, and both feed the tax model."""
    rows = attach_scenario(forecast_grid(payers, year), scenario)
    keep = [*rows.columns]
    rows = income.transform(rows).select(*keep, "predicted_income")
    rows = rows.withColumn("income", F.col("predicted_income"))
    keep += ["predicted_income", "income"]
    rows = transactions.transform(rows).select(*keep, "predicted_transactions")
    rows = rows.withColumn("transactions", F.col("predicted_transactions"))
    return tax.transform(rows).select(*FORECAST, *PREDICTED)


def freshness(real: DataFrame, predicted: DataFrame) -> DataFrame:
    """Last recorded and last predicted year, and whether the forecast must be remade."""
    last_real = real.agg(F.max("yr").alias("y"))
    last_predicted = predicted.agg(F.max("yr").alias("y"))
    years = real.sparkSession.range(1).select(
        last_real.scalar().alias("last_real_year"),
        last_predicted.scalar().alias("last_predicted_year"),
    )
    stale = F.col("last_real_year").isNotNull() & F.coalesce(
        F.col("last_predicted_year") <= F.col("last_real_year"), F.lit(True)
    )
    return years.withColumn("stale", stale)


def refresh_forecast(
    model: PipelineModel, facts: DataFrame, payers: DataFrame, path: str
) -> DataFrame:
    """The stored forecast; remade first if it does not reach past the recorded years."""
    stored = marts.open_table(facts.sparkSession, path, PREDICT)
    state = freshness(facts, stored).first()
    if not state["stale"]:
        return stored
    monthly = score_grid(model, payers_by_tax_type(facts, payers), state["last_real_year"] + 1)
    return marts.replace_year(monthly, path)
