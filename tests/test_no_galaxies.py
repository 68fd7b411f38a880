"""A density contrast of no points is no number, as in SQL: queries of galaxies on a table that has none."""

import math

import duckdb
import pytest

from meshlark.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", ["G05_cic_galaxies", "F08_galaxy_power"])
def test_none(spark, sf_dir, tmp_path, name):
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").limit(0).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    df = QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    found = con.execute(SQL[name])
    columns = [x[0] for x in found.description]
    plain = lambda rows: sorted(tuple("nan" if isinstance(x, float) and math.isnan(x) else x for x in r) for r in rows)
    want, got = plain(found.fetchall()), plain(tuple(r[c] for c in columns) for r in df.collect())
    assert any("nan" in r for r in want) and got == want
