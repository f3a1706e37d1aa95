"""User-level questions."""

from __future__ import annotations


def all_questions():
    """Every registered question by name."""
    from fiscus.plans import dashboard, growing, learning, relational, rule_checks, storage  # noqa: F401  (register on import)
    from fiscus.plans.catalogue import QUESTIONS

    return QUESTIONS
