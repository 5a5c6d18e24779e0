"""Every registered query against its SQL on the smallest tables."""

import pytest

from compare import compare
from docweave.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    assert compare(spark, FOLDER, QUERIES[name], ORACLES.get(name)) is None


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_runs(spark):
    from __spark_entry__ import entry

    assert entry(spark).columns and entry(spark).count() > 0
