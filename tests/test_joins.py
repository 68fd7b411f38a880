"""Range joins hold no side on the driver, however small their sizes are guessed."""

import random

import pytest

from meshlark.operators import rangejoin as R
from meshlark.plans import registry

QUERIES = registry.queries()


@pytest.mark.parametrize("name", ["J05_pair_counts", "J06_recentre", "K03_correlation"])
def test_probes_are_not_broadcast(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    df.collect()
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    sides = [line for line in plan.splitlines() if "Join Inner" in line and "ck#" in line]
    assert sides and all("rightHint=(strategy=shuffle_hash)" in line for line in sides)
    ran = df._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin [ci" in ran and "BroadcastHashJoin [ci" not in ran


def test_bins_are_not_found_in_the_join(spark, sf_dir):
    """A condition of a join that held the bins of its pairs would be too long to be compiled."""
    plan = QUERIES["K03_correlation"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    sides = [line for line in plan.splitlines() if "Join Inner" in line and "ck#" in line]
    assert sides and all("THEN 1 ELSE 0" not in line for line in sides)


@pytest.mark.parametrize("inner", [0.0, 0.5])
def test_distances_are_to_the_nearest_image(spark, inner):
    box, edges = 8.0, [0.5, 1.0, 2.0]
    draw = random.Random(1)
    rows = [(i, *[draw.randrange(512) / 64 for _ in range(3)], float(i % 5 + 1)) for i in range(200)]
    got = {r["bin"]: (r["pairs"], r["weight"]) for r in R.pair_counts(spark.createDataFrame(rows, "id long, x double, y double, z double, m double"), box, edges, inner=inner).collect()}
    want = {}
    for a in rows:
        for b in rows:
            d2 = sum(min((b[c] - a[c] + s * box) ** 2 for s in (-1, 0, 1)) for c in (1, 2, 3))
            if a[0] != b[0] and inner * inner <= d2 < edges[-1] ** 2:
                shell = sum(d2 >= e * e for e in edges)
                n, w = want.get(shell, (0, 0.0))
                want[shell] = (n + 1, w + a[4] * b[4])
    assert got == want and len(want) == (2 if inner else 3)


@pytest.mark.parametrize("name", ["P06_density_kick", "P11_random_particles", "F08_galaxy_power", "P09_weighted_sample"])
def test_particles_are_not_broadcast(spark, sf_dir, name):
    """Neither particles nor their densities, which are as many, whatever size a packed file seems to have."""
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().toString()
    assert "SortMergeJoin [id" in plan and "BroadcastHashJoin [id" not in plan
