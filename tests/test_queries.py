"""Every registered query that has SQL, beside that SQL."""

import pytest

import __spark_entry__ as entry
from tools import check


@pytest.fixture(scope="module")
def con(folder):
    return check.connect(folder)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_equal_to_sql(spark, con, folder, name):
    ok, text = check.compare(spark, con, name, folder)
    assert ok, text


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns == ["cue", "resp", "n", "conf", "lift"]
    assert out.count() > 0
