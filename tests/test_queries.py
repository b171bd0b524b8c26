"""Every query against its SQL over the smallest tables, and the shape of the registry."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))
from compare import rows_of  # noqa: E402

from reviewloom.plans import registry  # noqa: E402


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in Path(data).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, data, con, name):
    df = registry.QUERIES[name](spark, data)
    got = rows_of(df.columns, df.collect())
    if name in registry.ORACLE:
        rel = con.execute(registry.ORACLE[name])
        cols = [c[0] for c in rel.description]
        assert sorted(cols) == sorted(df.columns)
        assert got == rows_of(cols, rel.fetchall())
    else:
        assert got


def test_entry(spark, data):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
