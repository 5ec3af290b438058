"""Every query outside the optional part against its SQL; the others must give rows.

At the scale of the shared comparison: below it no hour holds all five parameters, and chart constants in the SQL are those of subgroups of five.
"""

from __future__ import annotations

import pytest

from millrace.plans import QUERIES, SQL
from tests.compare import rows_of, rows_of_sql


@pytest.fixture(scope="module")
def data() -> str:
    return "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, data, name):
    assert rows_of(QUERIES[name](spark, data)) == rows_of_sql(SQL[name], data)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, data, name):
    df = QUERIES[name](spark, data)
    assert df.columns and df.count() > 0


def test_empty_tables(spark):
    from millrace.plans import views

    assert QUERIES["reconstruction_error"](spark, "/root/testdata/sf0.001").count() == views.wide_hours(spark, "/root/testdata/sf0.001").count()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
