import duckdb
import pytest

import __spark_entry__
from foilframe.plans import catalog, reports  # noqa: F401

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


def shown(rows):
    text = lambda v: "null" if v is None or v != v else f"{v:.5f}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(text, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_agrees_with_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, D)
    cols = sorted(df.columns)
    got = shown(df.select(*cols).collect())
    if name in catalog.ORACLE_SQL:
        found = con.sql(catalog.ORACLE_SQL[name])
        assert sorted(found.columns) == cols
        assert got == shown(found.select(*[f'"{c}"' for c in cols]).fetchall())
    else:
        assert got


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
