"""Every query of the catalogue against its SQL in DuckDB."""

import math
from pathlib import Path

import duckdb
import pytest

from quern.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    return "[" + ",".join(map(plain, v)) + "]" if isinstance(v, list | tuple) else repr(v)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, sf, duck, name):
    got = catalogue.queries()[name](spark, sf)
    columns = sorted(got.columns)
    mine = sorted("|".join(plain(r[c]) for c in columns) for r in got.collect())
    rel = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    assert mine == sorted("|".join(plain(row[names.index(c)]) for c in columns) for row in rel.fetchall())


def test_division_by_zero_on_odd_rows(spark, tmp_path):
    path = tmp_path / "lineitem.parquet"
    duck = duckdb.connect()
    numbers, quantities = "NULL, 0, -3, 2, -2147483648", "NULL, '0', '-0.0', '-5', '5', 'nan', 'inf', '-inf'"
    duck.execute(f"COPY (SELECT CAST(1 AS BIGINT) AS l_orderkey, n AS l_linenumber, q AS l_quantity FROM (SELECT CAST(unnest([{numbers}]) AS INTEGER) AS n), (SELECT unnest(CAST([{quantities}] AS DOUBLE[])) AS q)) TO '{path}' (FORMAT parquet)")
    duck.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{path}'")
    mine = sorted("|".join(map(plain, r)) for r in catalogue.queries()["division_by_zero"](spark, str(tmp_path)).collect())
    assert mine == sorted("|".join(map(plain, r)) for r in duck.execute(catalogue.oracle_sql()["division_by_zero"]).fetchall())
