"""Bound members are found with no table of all members."""

import pytest

from meshlark.operators import halos as H
from meshlark.plans import halo_queries as Q
from meshlark.plans import registry


@pytest.mark.parametrize("name", ["A09_moments", "H07_bound_members", "H08_properties", "H09_axis_ratios", "H09_steepened_axes"])
def test_members_are_not_kept(spark, sf_dir, monkeypatch, name):
    """What is cut on the way is a row a halo and shell, or fewer, not a row a member."""
    kept = []

    def counted(df):
        kept.append(df.columns)
        return df.checkpoint()

    for module in (H, Q):
        monkeypatch.setattr(module, "cut", counted)
    df = registry.queries()[name](spark, sf_dir)
    assert kept and not any("dx" in columns for columns in kept)
    assert df.count() > 0


def test_same_as_of_a_table(spark, sf_dir):
    inside = Q.inside(spark, sf_dir).cache()
    want = H.bound(inside, H.profiles(inside, Q.EDGES), Q.STRENGTH).select("halo", "id", "shell").collect()
    got = Q.bound(spark, sf_dir).select("halo", "id", "shell").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and want


@pytest.mark.parametrize("name", ["A09_moments", "H08_properties", "H09_axis_ratios", "H09_steepened_axes"])
def test_pairs_do_not_leave_their_task(spark, sf_dir, monkeypatch, name):
    """Sums of bound members are made without a row a pair: no join of probes and points."""
    plans = []

    def seen(df):
        out = df.checkpoint()
        plans.append(df._jdf.queryExecution().toString())
        return out

    for module in (H, Q):
        monkeypatch.setattr(module, "cut", seen)
    df = registry.queries()[name](spark, sf_dir)
    df.collect()
    plans.append(df._jdf.queryExecution().toString())
    assert any("FlatMapCoGroupsInArrow" in p for p in plans)
    assert not any("strategy=shuffle_hash" in p for p in plans)


@pytest.mark.parametrize("part, hubble", [(1 << 17, 0.0), (7, 0.0), (1 << 17, 0.5)])
def test_sums_are_those_of_members(spark, sf_dir, monkeypatch, part, hubble):
    """Blocks whole or in parts, with some members unbound: the sums of the members one by one."""
    monkeypatch.setattr(H, "PART", part)
    halos, points = Q.view(spark, sf_dir, "halos").where(Q.F.col("m") > Q.LEAST), Q.points0(spark, sf_dir)
    args = (halos, points, Q.EDGES, Q.BOX, Q.STRENGTH, hubble)
    own = H.bound_members(*args)[0]
    assert 0 < own.count() < Q.inside(spark, sf_dir).count()
    want = {r["halo"]: r for r in H.moments(own).collect()}
    got = {r["halo"]: r for r in H.bound_moments(*args)[0].collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[h][c] - want[h][c]) <= 1e-9 * max(1.0, abs(want[h][c])) for h in want for c in H.SUMS)


def test_one_block_and_either_wall(spark):
    """A box of one block, in which the nearest image differs from point to point."""
    halos = spark.createDataFrame([(1, 0.5, 0.5, 3.5), (2, 2.0, 2.0, 2.0)], "id long, x double, y double, z double")
    points = spark.createDataFrame([(i, (i * 7 % 40) / 10, (i * 11 % 40) / 10, (i * 13 % 40) / 10, 0.0, 0.0, 0.1 * (i % 3), 1.0) for i in range(200)], "id long, x double, y double, z double, vx double, vy double, vz double, mass double")
    edges = [0.5, 1.0, 1.9]
    got = H.shell_sums(halos, points, edges, 4.0).select("halo", "shell", "n", "mass").collect()
    want = H.members(halos, points, edges, 4.0).groupBy("halo", "shell").agg(Q.F.count("id").alias("n"), Q.F.sum("mass").alias("mass")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and want


@pytest.mark.parametrize("part, rows", [(1 << 17, 1 << 17), (7, 50)])
def test_members_leave_their_task_as_found(spark, sf_dir, monkeypatch, part, rows):
    """No task hashes its points: members are found by blocks, whole or in parts, with all columns of a table of members."""
    monkeypatch.setattr(H, "PART", part)
    monkeypatch.setattr(H, "ROWS", rows)
    halos, points = Q.view(spark, sf_dir, "halos").where(Q.F.col("m") > Q.LEAST), Q.points0(spark, sf_dir)
    own = H.bound_members(halos, points, Q.EDGES, Q.BOX, Q.STRENGTH, 0.5)[0]
    plan = own._jdf.queryExecution().toString()
    assert "strategy=shuffle_hash" not in plan and "FlatMapGroupsInArrow" in plan
    inside = Q.inside(spark, sf_dir).cache()
    want = H.bound(inside, H.profiles(inside, Q.EDGES), Q.STRENGTH, 0.5).select(*H.MEMBER).collect()
    got = own.select(*H.MEMBER).collect()
    assert len(got) == len(want) > 0
    for a, b in zip(sorted(map(tuple, got)), sorted(map(tuple, want)), strict=True):
        assert a[:3] == b[:3] and all(abs(x - y) <= 1e-9 * max(1.0, abs(y)) for x, y in zip(a[3:], b[3:], strict=True))


@pytest.mark.parametrize("part, packed", [(1 << 17, 1 << 19), (300, 1000)])
def test_points_are_shuffled_packed(spark, sf_dir, monkeypatch, part, packed):
    """A row of points a task and block, of under half the bytes, with every point as it was."""
    monkeypatch.setattr(H, "PART", part)
    monkeypatch.setattr(H, "PACKED", packed)
    points = Q.points0(spark, sf_dir)
    odd = spark.createDataFrame([(-5, 1.5, 0.0, 31.5, -0.0, 1e300, 5e-324, 0.1), (7, 1.5, 0.0, 31.5, 1 / 3, float("inf"), -2.5, 3.0)], "id long, " + ", ".join(f"{c} double" for c in H.POINT))
    points = points.select("id", *H.POINT).unionByName(odd)
    pieces = H._blocks(Q.view(spark, sf_dir, "halos").select("id", *H.AXES), points, 12.0, Q.BOX, named=True)[1]
    rows, all_ = pieces.toArrow(), points.count()
    assert len(rows) < all_ / 100 and sum(rows.column("n").to_pylist()) == all_
    assert sum(map(len, rows.column("points").to_pylist())) < all_ * 8 * 8 / 2
    got, table = H._unpacked(rows, 8).view("int64"), points.toArrow()
    want = [table.column(c).to_numpy().view("int64") for c in (*H.POINT, "id")]  # bit for bit
    assert sorted(zip(*got.tolist(), strict=True)) == sorted(zip(*[x.tolist() for x in want], strict=True))


def test_members_meet_packed_points(spark, sf_dir):
    own = Q.bound(spark, sf_dir)
    assert "MapInArrow" in own._jdf.queryExecution().toString()
