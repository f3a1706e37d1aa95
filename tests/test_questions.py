"""Every registered question against its SQL, and the driver contract."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from check import compare, connect
from conftest import SMALL

import __spark_entry__ as entry
from fiscus.plans import all_questions

QUERIES = dict(all_questions())
ORACLE = {n: q for n, q in entry.oracle_sql().items() if n in QUERIES}


# Nothing may pair every row with every row, or leave the JVM row by row.
UNWANTED = (
    "CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
    "InPandas", "InArrow",
)


THREADS = 6


def check(spark, con, name) -> str:
    """Empty when the question gives what its SQL gives, by an acceptable plan."""
    df = QUERIES[name](spark, SMALL)
    if name in ORACLE:
        problem = compare(df, con, ORACLE[name])
    else:
        problem = "" if df.count() > 0 else "no rows"
    plan = df._jdf.queryExecution().executedPlan().toString()
    return problem or ", ".join(w for w in UNWANTED if w in plan)


@pytest.fixture(scope="module")
def outcomes(spark, request):
    """All selected questions, several at a time: most of a tiny query is planning."""
    names = {i.callspec.params["name"] for i in request.session.items if hasattr(i, "callspec")
             and "name" in i.callspec.params}
    con = connect(SMALL)
    with ThreadPoolExecutor(THREADS) as pool:
        jobs = {n: pool.submit(check, spark, con.cursor(), n) for n in sorted(names)}
        yield jobs
    con.close()


# 500 rounds take minutes whatever the data; test_learning checks the trees on fewer.
LONG = {"gbt_train"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - LONG))
def test_question(outcomes, name):
    assert outcomes[name].result() == ""


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "income_growth" in df.columns


def test_names_are_unique_and_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())
