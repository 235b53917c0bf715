"""Every plan with an oracle: Spark's rows are DuckDB's."""

import datetime
import math

import duckdb
import pytest

from inkspan.plans import catalogue
from inkspan.plans.dialect import TABLES


def canonical(value):
    if isinstance(value, float):
        return "null" if math.isnan(value) else f"{value:.6f}"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if value is None:
        return "null"
    if type(value).__name__ == "Decimal":
        return f"{float(value):.6f}"
    return str(value)


#: The size that has the letters beyond ASCII next to patterns, the copies and the passages that smaller tables lack.
LARGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{LARGER}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_rows_match(spark, duck, name):
    frame = catalogue.QUERIES[name](spark, LARGER)
    columns = sorted(frame.columns)
    ours = sorted(tuple(canonical(r[c]) for c in columns) for r in frame.collect())
    found = duck.execute(catalogue.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert ours == sorted(tuple(canonical(r[i]) for i in order) for r in found.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_others_run(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0
