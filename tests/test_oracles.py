"""Every core query with a statement gives what DuckDB gives; every other one runs and has a stable schema."""

import pytest

from compare import SMALL, connect, rows_of


def _core():
    from importlib import import_module

    import __spark_entry__ as entry

    modules = [import_module(f"tracklathe.plans.{m}") for m in entry.MODULES]
    return {n: (f, m.SQL.get(n)) for m in modules for n, f in m.QUERIES.items()}


CORE = _core()


@pytest.fixture(scope="module")
def duck():
    return connect()


@pytest.mark.parametrize("name", [n for n, (_, s) in CORE.items() if s])
def test_matches_statement(spark, duck, name):
    query, statement = CORE[name]
    df = query(spark, SMALL)
    want = duck.execute(statement)
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(names, want.fetchall())


@pytest.mark.parametrize("name", [n for n, (_, s) in CORE.items() if not s])
def test_runs(spark, name):
    df = CORE[name][0](spark, SMALL)
    assert df.columns and len(set(df.columns)) == len(df.columns)
    df.collect()


def test_entry_gives_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
