"""The driver contract on the smallest tables (skipped where they are absent)."""
import os

import pytest

import __spark_entry__ as entry

ROOT = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables")


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 90


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() == 1500 and len(set(df.columns)) == len(df.columns)


@pytest.mark.parametrize("name", ["asof_previous", "carry_forward", "upsert_nullsafe", "tokens", "novelty", "late_ratio", "section_warnings"])
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{ROOT}/{t}.parquet'")
    df = entry.queries()[name](spark, ROOT)
    cols = sorted(df.columns)
    cur = con.execute(f"SELECT {', '.join(cols)} FROM ({entry.oracle_sql()[name]})")
    assert sorted(str(tuple(r)) for r in df.select(*cols).collect()) == sorted(str(tuple(r)) for r in cur.fetchall())
