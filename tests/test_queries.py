"""Every query of the core that has SQL, against DuckDB on the smallest data."""

import oracle
import pytest

from heronry.plans import catalog, classify, dedupe, integrity, organise, sync

ALL = {n: (f, m.SQL.get(n)) for m in (catalog, classify, dedupe, integrity, organise, sync) for n, f in m.QUERIES.items()}


@pytest.fixture(scope="module")
def db(data):
    return oracle.connect(data)


@pytest.mark.parametrize("name", [n for n, (_, s) in ALL.items() if s])
def test_query(spark, db, data, name):
    f, sql = ALL[name]
    assert oracle.compare(spark, db, data, f, sql) is None


def test_flagship_and_names(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns
