"""Operators of a training-data pipeline. Nothing outside this package imports it."""

from __future__ import annotations


def llm_queries():
    """The registered query of each operator, by name."""
    from fiscus.llm import questions

    return dict(questions.QUERIES)


def llm_oracle_sql():
    """DuckDB SQL for the operators that SQL can express."""
    from fiscus.llm import questions

    return dict(questions.SQL)
