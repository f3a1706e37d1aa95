"""Registry of the questions: a name, the Spark job, and SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from fiscus.sources.warehouse import Warehouse, with_views


@dataclass(frozen=True)
class Question:
    name: str
    run: Callable[[Warehouse], DataFrame]
    sql: str | None
    views: tuple[str, ...]

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.run(Warehouse(spark, folder))

    @property
    def check_sql(self) -> str | None:
        return None if self.sql is None else with_views(self.sql, *self.views)


QUESTIONS: dict[str, Question] = {}


def question(name: str, sql: str | None = None, views: str = ""):
    """Register a job under ``name``; ``views`` lists the logical tables ``sql`` reads."""
    def register(run: Callable[[Warehouse], DataFrame]):
        if name in QUESTIONS:
            raise ValueError(f"{name} is registered twice")
        QUESTIONS[name] = Question(name, run, sql, tuple(views.split()))
        return run

    return register
