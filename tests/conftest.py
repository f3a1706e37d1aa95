import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fiscus.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cores=8, shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def folder(tmp_path):
    return lambda name: str(tmp_path / name)


FACTS = "taxpayer_id long, yr int, mon int, tax_type string, income decimal(18,2), tax decimal(18,2), transactions long"
PAYERS = (
    "taxpayer_id long, full_name string, passport_number string, inn string, "
    "taxpayer_type string, activity_type string, registration_district string, "
    "has_employees boolean, employees_count int"
)


@pytest.fixture(scope="session")
def make_facts(spark):
    from decimal import Decimal

    def make(rows):
        return spark.createDataFrame(
            [(p, y, m, t, Decimal(str(i)), Decimal(str(x)), n) for p, y, m, t, i, x, n in rows], FACTS
        )

    return make


@pytest.fixture(scope="session")
def make_payers(spark):
    def make(ids, **changes):
        rows = []
        for i in ids:
            row = dict(
                taxpayer_id=i, full_name=f"Payer {i}", passport_number=str(1000 + i),
                inn=str(100000 + i), taxpayer_type="SZ", activity_type="IT",
                registration_district="Невский", has_employees=False, employees_count=None,
            )
            row.update({k: v(i) for k, v in changes.items()})
            rows.append(tuple(row.values()))
        return spark.createDataFrame(rows, PAYERS)

    return make
