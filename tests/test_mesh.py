"""Invariants of meshes and transforms, and numpy as a second opinion."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshlark.functions import cosmology
from meshlark.operators import mesh as M
from meshlark.operators import spectra as S
from meshlark.plans.fixtures import view

N = 8


@pytest.fixture(scope="module")
def points(spark, sf_dir):
    return M.rescale(view(spark, sf_dir, "particles"), 32, N).cache()


def array(df, n=N, value="val"):
    out = np.zeros((n, n, n))
    for r in df.collect():
        out[r["i"] - 1, r["j"] - 1, r["k"] - 1] = r[value]
    return out


def test_mass_is_kept(points):
    assert abs(array(M.deposit(points, N)).mean()) < 1e-12


def test_uniform_lattice_is_flat(spark):
    assert np.abs(array(M.deposit(M.lattice(spark, N), N))).max() < 1e-9


def test_gather_of_a_constant_is_constant(spark, points):
    flat = M.nodes(spark, N).withColumn("val", F.lit(0.25))
    ids = points.withColumn("id", F.monotonically_increasing_id())
    assert {round(r["dens"], 12) for r in M.gather(ids, flat, N).collect()} == {1.25}


def test_restrict_and_prolong_keep_constants_and_means(spark, points):
    flat = M.nodes(spark, N).withColumn("val", F.lit(3.0))
    assert set(array(M.restrict(flat), N // 2).ravel()) == {3.0}
    assert set(array(M.prolong(flat, 2 * N), 2 * N).ravel()) == {3.0}
    mesh = M.deposit(points, N)
    assert abs(array(M.prolong(mesh, 2 * N), 2 * N).mean() - array(mesh).mean()) < 1e-12


def test_result_does_not_depend_on_partitions(points):
    a, b = (array(M.deposit(points.repartition(p), N)) for p in (1, 7))
    assert (a == b).all()


@pytest.mark.parametrize("whole", [True, False])
def test_transform(points, whole):
    mesh = M.deposit(points, N).cache()
    delta = array(mesh)
    got = S.transform(mesh, N, whole=whole)
    want = np.fft.fftn(delta) / N**3
    assert np.abs(array(got, value="re") - want.real).max() < 1e-12 and np.abs(array(got, value="im") - want.imag).max() < 1e-12
    back = S.fft3(got, N, inverse=True, whole=whole)
    assert np.abs(array(back, value="re") - delta).max() < 1e-12
    assert abs((np.abs(want) ** 2).sum() - (delta**2).mean()) < 1e-12


def test_power_against_numpy(points):
    delta = array(M.deposit(points, N))
    amp = np.abs(np.fft.fftn(delta) / N**3) ** 2
    k1 = np.minimum(np.arange(N), N - np.arange(N))
    k = np.sqrt(k1[:, None, None] ** 2 + k1[None, :, None] ** 2 + k1[None, None, :] ** 2)
    for r in S.power(S.transform(M.deposit(points, N), N), N, 100.0).collect():
        own = (np.maximum(np.floor(k + 0.5), 1) == r["bin"]) & (k > 0)
        assert own.sum() == r["n_modes"] and abs(amp[own].mean() * 1e6 / r["p0"] - 1) < 1e-9


def test_potential_has_the_density_as_laplacian(points):
    mesh = M.deposit(points, N)
    assert np.abs(array(M.laplacian(S.potential(mesh, N), N)) - array(mesh)).max() < 1e-9


def test_initial_conditions(spark):
    field = S.random_field(spark, N, 100.0, cosmology.power_law(F.col("k")), seed=2)
    d = array(S.fft3(field, N, inverse=True), value="im")
    assert np.abs(d).max() < 1e-9  # a real field
    fixed = {round(r["amp"], 6) for r in S.modes(S.random_field(spark, N, 100.0, F.lit(5.0), fixed=True), N).collect()}
    assert fixed == {round(5.0 / 100.0**3, 6)}
    a, b = (array(S.random_field(spark, N, 100.0, F.lit(5.0), reverse=r), value="re") for r in (False, True))
    assert np.abs(a + b).max() < 1e-12
    moved = S.zeldovich(S.displacements(field, N), N, 0.1, 1.0).collect()
    assert len(moved) == N**3 and all(1 <= r[a] < N + 1 for r in moved for a in "xyz")


def test_sphere_has_no_mean(spark):
    assert abs(array(M.sphere(spark, 16), 16).mean()) < 1e-12
