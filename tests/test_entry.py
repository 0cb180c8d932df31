import duckdb
import pytest

import __spark_entry__
from filamenta import plans

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def _value(x):
    try:
        return f"{float(x):.6g}"
    except (TypeError, ValueError):
        return str(x)


def test_names_agree():
    assert set(plans.ORACLE_SQL) <= set(plans.QUERIES) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    found = duck.execute(plans.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(tuple(_value(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert sorted(tuple(_value(r[c]) for c in columns) for r in df.collect()) == want
