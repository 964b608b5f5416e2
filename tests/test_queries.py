"""Every query of the engine against its SQL in DuckDB."""

import duckdb
import pytest

from relgrid import queries

TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    text = lambda v: "~" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(text(v[k]) for k in order) for v in values)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf_dir, duck, name):
    frame = queries.QUERIES[name](spark, sf_dir)
    want = duck.sql(queries.SQL[name])
    assert sorted(frame.columns) == sorted(want.columns)
    assert rows(frame.columns, [tuple(r) for r in frame.collect()]) == rows(want.columns, want.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["resource_id", "truncated"]
    assert set(queries.SQL) <= set(__spark_entry__.oracle_sql()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
