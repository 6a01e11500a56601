"""Every registered query against its SQL oracle."""

import duckdb
import pytest

from threatloom.plans.oracle import oracles
from threatloom.plans.queries import registry
from threatloom.sources.sample_tables import SOURCES

FOLDER = "/root/testdata/sf0.001"
ORACLES = oracles()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in SOURCES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    yield con
    con.close()


def comparable(rows):
    flat = [tuple(round(v, 6) + 0.0 if isinstance(v, float) else v for v in row) for row in rows]
    return sorted(flat, key=lambda row: tuple(map(str, row)))


def test_every_query_has_an_oracle():
    assert set(registry()) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, duck, name):
    answer = duck.sql(ORACLES[name])
    columns = list(answer.columns)
    wanted = comparable(answer.fetchall())
    got = registry()[name](spark, FOLDER)
    assert sorted(got.columns) == sorted(columns)
    assert comparable(tuple(r[c] for c in columns) for r in got.collect()) == wanted
    assert wanted
