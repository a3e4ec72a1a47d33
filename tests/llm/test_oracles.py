"""Every operator query that SQL can express against its SQL in another engine."""

import datetime

import duckdb
import pytest

from wakeline.llm.oracles import ORACLE_SQL
from wakeline.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def sorted_rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda v: v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cursor = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    want = sorted_rows(names, cursor.fetchall())
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted_rows(df.columns, df.collect()) == want
