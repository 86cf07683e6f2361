"""Every registered query of the library against its SQL on the smallest tables."""

import duckdb
import pytest
from verdance.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def _rows(df):
    columns = sorted(df.columns)
    plain = df[columns].astype(object).where(df[columns].notna(), None)
    text = lambda v: "" if v is None else repr(float(v) + 0.0) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return columns, sorted(tuple(text(v) for v in row) for row in plain.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(name, spark, sf_dir, duck):
    got = catalog.queries()[name](spark, sf_dir).toPandas()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert len(got)
    else:
        assert _rows(got) == _rows(duck.sql(sql).df())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
