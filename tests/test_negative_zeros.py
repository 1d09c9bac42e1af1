"""Sums a hair below zero round to the zero that the SQL gives, sign and all."""

import duckdb

from touchline import catalog


def test_sequences_keep_the_sign_of_zero(spark, sf_dir):
    con = duckdb.connect()
    for t in ("lineitem", "region"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(catalog.oracle_sql()["d05_sequences"]).fetchall()
    got = catalog.queries()["d05_sequences"](spark, sf_dir).collect()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)
    assert any("-0.0" in str(r) for r in want)
