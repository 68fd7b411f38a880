"""Particles at one place share an id: by-id queries against their SQL on a table that holds every row twice."""

import duckdb
import pytest

from meshlark.plans import registry
from tests.test_queries import same

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def copies(spark, sf_dir, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("copies"))
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_orderkey < 200")
    rows.unionByName(rows).coalesce(1).write.parquet(f"{d}/lineitem.parquet")
    return d


@pytest.mark.parametrize("name", ["G02_gather", "P06_density_kick", "P11_random_particles", "G18_force_on_particles"])
def test_by_id(spark, copies, name):
    df = QUERIES[name](spark, copies)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{copies}/lineitem.parquet/*.parquet')")
    found = con.execute(SQL[name])
    columns = [x[0] for x in found.description]
    want, got = sorted(found.fetchall()), sorted(tuple(r[c] for c in columns) for r in df.collect())
    assert len(got) == len(want) > 0
    assert all(same(x, y) for a, b in zip(got, want, strict=True) for x, y in zip(a, b, strict=True))
