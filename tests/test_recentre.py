"""Rows move to the mean of what is around them: pairs are found by blocks and never leave their task."""

import random

import pytest

from meshlark.operators import rangejoin as R
from meshlark.plans import registry

BOX = 8.0


@pytest.mark.parametrize("name", ["J06_recentre", "J06_settled_centres"])
def test_pairs_do_not_leave_their_task(spark, sf_dir, name):
    """Blocks meet by their place alone; before, the join made a row of each pair, of which there are as many as rows squared."""
    plan = registry.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    sides = [line for line in plan.splitlines() if "Join Inner" in line and "ck#" in line]
    assert sides and all("<" not in line and "rightHint=(strategy=shuffle_hash)" in line for line in sides)


@pytest.mark.parametrize("part, least", [(1 << 17, 1), (7, 1), (1 << 17, 3)])
def test_means_of_what_is_around(spark, monkeypatch, part, least):
    """Blocks whole or in parts, over the walls, with a reach of each row's own and with unknown places and velocities."""
    monkeypatch.setattr(R, "PART", part)
    draw = random.Random(2)
    place = lambda: [draw.randrange(512) / 64 for _ in range(3)]
    halos = [(i, *place(), draw.randrange(1, 160) / 64) for i in range(60)] + [(60, None, 1.0, 1.0, 1.0), (61, 1.0, 1.0, 1.0, None), (62, 1.0, 1.0, 1.0, 5.0)]
    points = [(i, *place(), *[None if draw.random() < 0.1 else draw.randrange(-64, 64) / 64 for _ in range(3)]) for i in range(300)] + [(300, 1.0, None, 1.0, 1.0, 1.0, 1.0)]
    h = spark.createDataFrame(halos, "id long, x double, y double, z double, own double")
    p = spark.createDataFrame(points, "id long, x double, y double, z double, vx double, vy double, vz double")
    got = {r["id"]: tuple(r[c] for c in ("x", "y", "z", "vx", "vy", "vz", "n")) for r in R.recentre(h, p, R.F.col("own"), BOX, 1.0, least).collect()}

    def near(a, b):
        return b - a - (BOX if b - a > BOX / 2 else 0) + (BOX if b - a < -BOX / 2 else 0)

    want = {}
    for i, *at, reach in halos:
        offsets = [(*[near(a, b) for a, b in zip(at, q[1:4], strict=True)], *q[4:]) for q in points if None not in (*at, *q[1:4])]
        found = [d for d in offsets if reach is not None and sum(x * x for x in d[:3]) < reach * reach]
        found = found if len(found) >= least else []
        moved = [a + sum(d[k] for d in found) / len(found) if found else a for k, a in enumerate(at)]
        known = [[d[k] for d in found if d[k] is not None] for k in (3, 4, 5)]
        want[i] = (*[x if x is None else x - BOX if x >= BOX else x + BOX if x < 0 else x for x in moved], *[sum(v) / len(v) if v else 0.0 for v in known], len(found))
    assert got == want and len({v[6] for v in want.values()}) > 10
