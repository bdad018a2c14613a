"""Every registered query against its reference SQL on the smallest folder (TALLY_SF picks another)."""

import os

import pytest
from harness import engine, problems

from tallyscope.plans.all import ORACLES, QUERIES

FOLDER = f"/root/testdata/sf{os.environ.get('TALLY_SF', '0.001')}"
# Queries that rightly return nothing on the smallest folder; any other must give rows.
MAY_BE_EMPTY = {"ingest_new"}


@pytest.fixture(scope="module")
def con():
    return engine(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    why, _ = problems(spark, con, FOLDER, QUERIES[name], ORACLES.get(name))
    assert why == "" or (why == "both empty" and name in MAY_BE_EMPTY), why


def test_contract():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.queries()) > 150
