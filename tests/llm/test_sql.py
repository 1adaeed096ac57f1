"""Every query of the ten that has SQL gives DuckDB's rows over whole tables."""

import duckdb
import pytest

from tesserae.llm.queries import oracle_sql, queries

from . import cases


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows(spark, name):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    got = queries()[name](spark, folder)
    cases.same(got, con.execute(f"SELECT {', '.join(got.columns)} FROM ({oracle_sql()[name]})").fetchall())


def test_all_ten_are_registered():
    assert [int(n[2:].split("_")[0]) for n in queries()] == list(range(1, 11))
