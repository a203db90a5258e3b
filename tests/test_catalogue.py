"""Every registered query against its reference SQL."""

import os

import oracle
import pytest

from tablepact import catalogue

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF_DIR):
        pytest.skip(f"no tables at {SF_DIR}")
    return oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, SF_DIR)
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert oracle.difference(df, duck, sql) is None


# Rows of the operator inventory, by group.
INVENTORY = dict(S=16, P=17, C=7, R=7, K=25, V=11, G=17, H=15, L=3, A=6, X=3)


def test_every_inventory_row_has_a_query():
    wanted = {f"{group}{i}" for group, n in INVENTORY.items() for i in range(1, n + 1)}
    covered = {c for entry in catalogue.ENTRIES.values() for c in entry.covers}
    assert covered == wanted
