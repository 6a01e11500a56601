"""The queries that have SQL, against it."""

import duckdb
import pytest

from threatloom.llm.oracle import oracles
from threatloom.llm.queries import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracles()))
def test_matches_oracle(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    answer = con.sql(oracles()[name])
    columns, wanted = list(answer.columns), answer.fetchall()
    got = registry()[name](spark, FOLDER)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(str, wanted))
    assert wanted


def test_every_query_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registry()) == list(range(1, 14))
