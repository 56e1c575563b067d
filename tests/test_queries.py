"""Every query against its SQL on DuckDB."""

import math

import duckdb
import pytest

from loomlake.plans.catalogue import ORACLE_SQL, QUERIES


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if type(v).__name__ == "Decimal":
        return round(float(v), 9)
    return v


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    df = QUERIES[name](spark, data)
    found = df.collect()
    if name not in ORACLE_SQL:
        assert found
        return
    con = duckdb.connect()
    for table in "region nation customer supplier part orders lineitem events documents".split():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    r = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(df.columns)
    a, b = rows(df.columns, found), rows(names, r.fetchall())
    assert len(a) == len(b)
    assert a == b, next((x, y) for x, y in zip(a, b) if x != y)
