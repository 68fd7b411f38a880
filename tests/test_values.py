"""Queries that no SQL states: their values against numpy, or against what defines them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshlark.functions import cosmology as K
from meshlark.plans import registry
from meshlark.plans.mesh_queries import SMALL
from meshlark.plans.spectra_queries import BOX

QUERIES, SQL = registry.queries(), registry.oracle_sql()
N = SMALL


def cube(rows, *columns):
    out = np.zeros((N, N, N, len(columns)))
    for r in rows:
        out[r["i"] - 1, r["j"] - 1, r["k"] - 1] = [r[c] for c in columns]
    return out


def waves():
    k = np.fft.fftfreq(N, 1 / N)
    return np.meshgrid(k, k, k, indexing="ij")


@pytest.fixture(scope="module")
def modes(spark, sf_dir):
    z = cube(QUERIES["F13_random_field"](spark, sf_dir).collect(), "re", "im")
    return z[..., 0] + 1j * z[..., 1]


def test_every_query_is_held_against_something():
    here = {"F13_random_field", "F14_displacements", "F15_zeldovich", "F16_fixed_amplitudes", "H01_finder", "N02_sigma_of_mass", "N07_spectrum_table", "R02_normal_numbers", "T01_evolution", "X13_background"}
    fields = {n for n in QUERIES if "_field_" in n and n[0] == "X"}
    assert set(QUERIES) - set(SQL) == here | fields


def test_modes_of_a_real_field_with_the_power(modes):
    assert abs(np.fft.ifftn(modes).imag).max() < 1e-12 * abs(np.fft.ifftn(modes)).max()
    kx, ky, kz = waves()
    k = np.sqrt(kx**2 + ky**2 + kz**2) * 2 * np.pi / BOX
    x = k / 0.02
    power = 2e4 * x * (1 + x * x) ** -1.25
    some = k > 0
    ratio = abs(modes[some]) ** 2 * BOX**3 / power[some]
    assert abs(ratio.mean() - 1) < 0.05 and abs(ratio.std() - 1) < 0.1 and modes[0, 0, 0] == 0


def test_displacements_and_particles(spark, sf_dir, modes):
    """i k / k**2 times the modes, back in space; particles are the lattice moved by half of it."""
    k = waves()
    k2 = sum(x**2 for x in k)
    k2[0, 0, 0] = 1
    want = []
    for x in k:
        f = np.where((k2 == 0) | (abs(x) == N // 2), 0, x / k2) * (N / (2 * np.pi))
        want.append(np.fft.ifftn(1j * f * modes).real * N**3)
    got = cube(QUERIES["F14_displacements"](spark, sf_dir).collect(), "sx", "sy", "sz")
    scale = max(abs(w).max() for w in want)
    assert all(abs(got[..., a] - w).max() < 1e-9 * scale for a, w in enumerate(want))
    points = {r["id"]: r for r in QUERIES["F15_zeldovich"](spark, sf_dir).collect()}
    for (i, j, l), v in np.ndenumerate(got[..., 0]):
        r = points[(i * N + j) * N + l]
        assert abs((r["x"] - (i + 1 + 0.5 * v) + N / 2) % N - N / 2) < 1e-9 and abs(r["vx"] - v) < 1e-9 and 1 <= r["x"] < N + 1
    assert len(points) == N**3


def test_fixed_amplitudes_come_in_opposite_pairs(spark, sf_dir):
    rows = QUERIES["F16_fixed_amplitudes"](spark, sf_dir).collect()
    one, two = (cube([r for r in rows if r["pair"] == p], "re", "im") for p in (1, 2))
    assert abs(one + two).max() < 1e-15
    kx, ky, kz = waves()
    x = np.sqrt(kx**2 + ky**2 + kz**2) * 2 * np.pi / BOX / 0.02
    want = np.sqrt(2e4 * x * (1 + x * x) ** -1.25 / BOX**3)
    assert np.allclose(np.hypot(one[..., 0], one[..., 1]), want, rtol=1e-9, atol=1e-12)


def test_normal_numbers(spark, sf_dir):
    m = QUERIES["R02_normal_numbers"](spark, sf_dir).agg(F.avg("g"), F.stddev("g"), F.skewness("g"), F.kurtosis("g"), F.count("g"), F.count_distinct("g")).first()
    assert abs(m[0]) < 0.1 and abs(m[1] - 1) < 0.08 and abs(m[2]) < 0.25 and abs(m[3]) < 0.5 and m[4] == m[5]


def test_catalog_of_the_finder(spark, sf_dir):
    """Bound, enclosed and none within a heavier one's radius."""
    rows = [r.asDict() for r in QUERIES["H01_finder"](spark, sf_dir).collect()]
    assert rows and all(r["rvir"] > 0 and r["mvir"] > 0 and 0 <= r["ca"] <= r["ba"] <= 1 and r["n"] >= 1 for r in rows if r["ba"] == r["ba"])
    apart = lambda a, b: sum((a[c] - b[c]) ** 2 for c in "xyz")
    assert not [1 for a in rows for b in rows if b["mvir"] > a["mvir"] and apart(a, b) < b["rvir"] ** 2]


def test_sigma_of_mass_and_the_table(spark, sf_dir):
    table = QUERIES["N07_spectrum_table"](spark, sf_dir).orderBy("k").collect()
    k, p = (np.array([r[c] for r in table]) for c in ("k", "p"))

    def sigma(radius):  # by the trapezium rule on a fine grid of ln k, with slopes 1 and -3 outside the table
        x = np.linspace(np.log(1e-5), np.log(100 / radius), 200_000)
        q = np.exp(x)
        inside = np.exp(np.interp(x, np.log(k), np.log(p)))
        power = np.where(q < k[0], p[0] * q / k[0], np.where(q > k[-1], p[-1] * (q / k[-1]) ** -3.0, inside))
        y = q * radius
        window = 3 * (np.sin(y) - y * np.cos(y)) / y**3
        return np.sqrt(np.trapezoid(power * q**3 * np.where(y < 1e-2, 1 - y * y / 10, window) ** 2, x) / (2 * np.pi**2))

    assert abs(sigma(8.0) - 0.8) < 1e-4
    rows = QUERIES["N02_sigma_of_mass"](spark, sf_dir).orderBy("mass_mean").collect()
    c = K.Cosmology()
    for r in rows:
        radius = (1e10 * r["mass_mean"] / (4 * np.pi / 3 * 2.774e11 * c.omega_m)) ** (1 / 3)
        assert abs(r["sigma"] / sigma(radius) - 1) < 1e-3 and r["slope"] < 0
    assert all(a["sigma"] > b["sigma"] for a, b in zip(rows, rows[1:], strict=False))


def test_two_steps_of_evolution(spark, sf_dir):
    """Every particle once, in the box; the total momentum stays what it was, as forces come in pairs."""
    rows = QUERIES["T01_evolution"](spark, sf_dir).collect()
    assert sorted(r["id"] for r in rows) == list(range(N**3)) and all(1 <= r[c] < N + 1 for r in rows for c in "xyz")
    speed = np.array([[r["vx"], r["vy"], r["vz"]] for r in rows])
    assert abs(speed.mean(axis=0)).max() < 0.02 * speed.std()


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if "_field_" in n and n[0] == "X" and n not in SQL))
def test_fields_solve_their_equations(spark, sf_dir, name):
    got = cube(QUERIES[name](spark, sf_dir).collect(), "val", "residual")
    assert abs(got[..., 1]).max() < 1e-6 and np.isfinite(got).all() and got[..., 0].std() > 0


def test_background_reaches_today(spark, sf_dir):
    rows = QUERIES["X13_background"](spark, sf_dir).orderBy("a").collect()
    assert abs(rows[0]["a"] - 1e-4) < 1e-12 and abs(rows[-1]["a"] - 1) < 1e-9 and abs(rows[-1]["h"] - 1) < 1e-3
    # early on matter alone fills the universe: H falls as a**-1.5
    a, b = rows[100], rows[200]
    assert abs(np.log(b["h"] / a["h"]) / np.log(b["a"] / a["a"]) + 1.5) < 0.05
