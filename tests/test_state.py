"""Relaxation, time steps, cosmology, catalogs and binary files."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshlark.functions import cosmology as K
from meshlark.operators import catalog as C
from meshlark.operators import halos as H
from meshlark.operators import rangejoin as R
from meshlark.plans.fixtures import view
from meshlark.sources import snapshot, text
from meshlark.streaming import blocks, evolve, relax

MODELS = [relax.CurvatureGravity(cells=16), relax.CurvatureGravity(n=1, cells=16), relax.CurvatureGravity(n=2, cells=16), relax.BraneWorld(), relax.Symmetron(cells=16), relax.KineticScreening(cells=16), relax.CoupledScalar(cells=16)]


@pytest.fixture(scope="module")
def rho():
    r = np.random.default_rng(1).normal(size=(16, 16, 16)) * 0.5
    return r - r.mean()


@pytest.mark.parametrize("model", MODELS, ids=lambda m: type(m).__name__)
@pytest.mark.parametrize("kind", "VFW")
def test_cycles_converge(model, rho, kind):
    s = relax.solve(model, rho, kind)
    assert s.residuals[-1] < 1e-7 and all(b < a for a, b in zip(s.residuals, s.residuals[1:], strict=False))


@pytest.mark.parametrize("model", MODELS, ids=lambda m: type(m).__name__)
@pytest.mark.parametrize("kind", "VF")
def test_blocks_equal_one_task(spark, model, kind, rho):
    """A cycle by blocks of 8 cells, on two levels above the one that is solved whole, is the cycle of the whole mesh."""
    if kind == "F" and type(model).__name__ not in ("Symmetron", "BraneWorld"):
        pytest.skip("two models are enough for the order of levels")
    n = 32
    mesh = np.tile(rho, (2, 2, 2)) + np.random.default_rng(5).normal(size=(n, n, n)) * 0.1
    mesh -= mesh.mean()
    i, j, k = (x.ravel() + 1 for x in np.indices(mesh.shape))
    df = spark.createDataFrame(list(zip(i.tolist(), j.tolist(), k.tolist(), mesh.ravel().tolist(), strict=True)), "i int, j int, k int, val double")
    got, told = blocks.solve(df, n, model, kind, most=1, level=blocks.Level(n, 16), whole=8)
    want = relax.solve(model, mesh, kind, most=1)
    assert abs(told[0] / want.residuals[0] - 1) < 1e-6
    u = np.zeros(mesh.shape)
    for r in got.collect():
        u[r["i"] - 1, r["j"] - 1, r["k"] - 1] = r["val"]
    scale = np.abs(want.field).max()
    assert np.abs(u - want.field).max() < 1e-9 * scale


def test_narrow_blocks_relax_in_several_steps(spark, rho):
    """Four sweeps need wider margins than blocks of 4 cells have."""
    model, level = relax.CurvatureGravity(cells=16), blocks.Level(16, 4)
    i, j, k = (x.ravel() + 1 for x in np.indices(rho.shape))
    df = spark.createDataFrame(list(zip(i.tolist(), j.tolist(), k.tolist(), rho.ravel().tolist(), strict=True)), "i int, j int, k int, val double")
    state = blocks.smooth(blocks.of_mesh(df, level, model.start()), level, model, 4)
    u = np.zeros(rho.shape)
    for r in blocks.to_mesh(state.select("b", "u", F.col("wanted").alias("residual")), level).collect():
        u[r["i"] - 1, r["j"] - 1, r["k"] - 1] = r["val"]
    want = relax.relax(model, np.full(rho.shape, model.start()), rho, np.zeros(rho.shape), 1.0, 4)
    assert np.allclose(u, want, rtol=1e-12)


def test_sides_of_blocks():
    assert (blocks.first_level(2000).side, blocks.first_level(256).side, blocks.first_level(96).side, blocks.first_level(7).side) == (80, 64, 96, 7)


def test_a_solution_stays(rho):
    model = relax.CurvatureGravity(cells=16)
    u = relax.solve(model, rho, enough=1e-15).field
    again = relax.cycle(model, u, rho, np.zeros_like(rho))
    assert np.abs(again / u - 1).max() < 1e-6


def test_weights_of_levels():
    x = np.random.default_rng(2).normal(size=(8, 8, 8))
    assert np.allclose(relax.prolonged(np.ones((4, 4, 4))), 1) and np.isclose(relax.prolonged(x).mean(), x.mean())
    assert np.allclose(relax.restricted(np.ones((8, 8, 8))), 1)


def test_cubic_roots():
    p, q = np.array([3.0, -3.0, 0.0, 1.0, -2.0]), np.array([-4.0, 1.0, -8.0, 0.0, 0.1])
    x = relax.cubic_root(p, q)
    assert np.abs(x**3 + p * x + q).max() < 1e-9


def test_background_ends_today():
    rows = relax.background(0.3, -0.1, 0.1)
    assert abs(rows[-1][0] - 1) < 1e-9 and abs(rows[-1][3] - 1) < 1e-3


def test_growth():
    flat = K.Cosmology(1.0, 0.0)
    assert abs(K.growth(flat, 0.5) - 0.5) < 1e-4 and abs(K.age(flat, 1.0) - 2 / 3) < 1e-6
    c = K.Cosmology()
    assert abs(K.growth(c, 1.0) / K.growth_ode(c, 1.0) - 1) < 1e-3


def test_sigma8():
    k = tuple(10 ** (x / 20 - 4) for x in range(120))
    t = K.normalised(K.Cosmology(), K.PowerTable(k, tuple(1e4 * x / (1 + (x / 0.02) ** 2) ** 1.25 for x in k)))
    assert abs(K.sigma_radius(t, 8.0) - 0.8) < 1e-9 and K.log_slope(K.Cosmology(), t, 1e13) < 0
    assert abs(t(np.array([1e-5]))[0] / t.p[0] - 1e-5 / k[0]) < 1e-9


def test_concentration():
    c = np.array([3.0, 8.0, 20.0])
    assert np.allclose(K.concentration(np.sqrt(K.concentration_ratio(c))), c, rtol=1e-6) and np.isnan(K.concentration(np.array([0.5])))[0]
    assert np.allclose(K.mass_at_overdensity(np.array([5.0]), np.array([7.0]), 1.0), 5.0) and K.mass_at_overdensity(np.ones(1), np.full(1, 7.0), 2.5)[0] < 1


def test_steps_keep_particles_and_a_lattice_at_rest(spark):
    from meshlark.operators import mesh as M

    still = M.lattice(spark, 8).withColumns({v: F.lit(0.0) for v in ("vx", "vy", "vz")})
    seen = []
    end, clock = evolve.run(still, 8, evolve.Clock(0.1, 0, 0.01), 2, 0.3, lambda p, c: seen.append(c.step), 1)
    assert seen == [1, 2] and abs(clock.a - 0.12) < 1e-12
    assert end.count() == 512 and end.agg(F.max(F.abs("vx"))).first()[0] < 1e-9


def test_a_run_goes_on_where_it_was_saved(spark, tmp_path):
    """Two steps at once, or one, a restart from files and another; with a scalar field and friction."""
    points = spark.range(512).select("id", *[(1 + (F.col("id") * p % 1024) / 128.0).alias(a) for a, p in zip("xyz", (7, 11, 13), strict=True)], *[(F.col("id") % q / 64.0).alias(v) for v, q in (("vx", 5), ("vy", 3), ("vz", 2))])
    fifth = evolve.FifthForce(lambda a: relax.CoupledScalar(a=a, cells=8), lambda a: 0.01 / a, friction=lambda a: 1 - 0.1 * a)
    clock, path, log = evolve.Clock(0.1, 0, 0.01), str(tmp_path / "state"), []
    save = lambda p, c: evolve.save(p, c, path)
    end, _ = evolve.run(points, 8, clock, 2, 0.3, fifth=fifth, log=log)
    evolve.run(points, 8, clock, 1, 0.3, save, 1, fifth)
    back, at = evolve.resume(spark, path)
    assert at == evolve.Clock(0.11, 1, 0.01)
    again, last = evolve.run(back, 8, at, 1, 0.3, fifth=fifth)
    want = {r["id"]: r for r in end.collect()}
    assert last.step == 2 and all(abs(r[c] - want[r["id"]][c]) < 1e-9 for r in again.collect() for c in ("x", "y", "z", "vx", "vy", "vz"))
    plain = {r["id"]: r["vx"] for r in evolve.run(points, 8, clock, 2, 0.3)[0].collect()}
    assert max(abs(plain[i] - want[i]["vx"]) for i in want) > 1e-6
    rows = text.parse_timing(spark.createDataFrame([(x,) for x in log], "value string")).orderBy("step").collect()
    assert [r["step"] for r in rows] == [1, 2] and all(abs(r["total"] - r["density"] - r["force"] - r["move"] - r["field"] - r["io"]) < 1e-3 and r["field"] > 0 for r in rows)


def test_steps_by_error():
    rows = K.adaptive_steps(lambda t, y: np.array([y[1], -y[0]]), 0.0, 20.0, np.array([0.0, 1.0]), 1e-9)
    assert abs(rows[-1][0] - 20) < 1e-12 and all(abs(y[0] - np.sin(t)) < 1e-6 for t, y in rows)
    stiff = K.adaptive_steps(lambda t, y: np.array([-2 * t * y[0]]), -6.0, 6.0, np.array([np.exp(-36.0)]), 1e-8)
    steps = np.diff([t for t, _ in stiff])
    assert abs(stiff[-1][1][0] / np.exp(-36.0) - 1) < 1e-4 and steps.max() > 2 * steps.min()


def test_schedule():
    s = evolve.schedule(0.1, 0.001, 0.05)
    assert s[0] == (0, 0.1, 0.001) and s[-1][1] < 1 <= s[-1][1] + s[-1][2] and max(x[2] for x in s) > 0.001


def test_adaptive_bins_hold_enough():
    counts = [(i, (i * 7) % 13) for i in range(200)]
    edges = C.adaptive_edges(counts, 40, 1.5)
    assert edges[0][0] == 0 and edges[-1][1] == 199 and all(b == a + 1 for (_, a), (b, _) in zip(edges, edges[1:], strict=False))
    assert all(sum(n for b, n in counts if lo <= b <= hi) >= 40 for lo, hi in edges[:-1])


def test_pairs_are_symmetric_and_containment_has_one_answer(spark, sf_dir):
    h = view(spark, sf_dir, "halos").cache()
    assert all(r["pairs"] % 2 == 0 for r in R.pair_counts(h, 32.0, [0.5, 1.0, 2.0]).collect())
    a = {r["id"] for r in R.remove_contained(h, 32.0, 2.0).collect()}
    assert a == {r["id"] for r in R.remove_contained_simple(h).collect()}


def test_shapes(spark):
    r = np.random.default_rng(3).normal(size=(3000, 3)) * [4, 2, 1]
    df = spark.createDataFrame([(1, float(x), float(y), float(z), 0.0, 0.0, 0.0, 1.0, 0.0) for x, y, z in r], "halo long, dx double, dy double, dz double, ux double, uy double, uz double, mass double, d2 double")
    got = H.axis_ratios(H.moments(df)).first()
    assert abs(got["ba"] - 0.5) < 0.05 and abs(got["ca"] - 0.25) < 0.03


# ---- files

def test_snapshot_round_trip(spark, tmp_path):
    n, page = 1000, 64
    df = spark.range(n).select("id", *[(1 + (F.col("id") * p % 4096) / 128.0).alias(c) for c, p in zip(snapshot.COLUMNS, (7, 11, 13, 17, 19, 23), strict=True)])
    header = snapshot.Header("a test", aexpn=0.5, ngrid=32, nrow=10)
    header.extras[-1] = 250.0
    snapshot.write(df, str(tmp_path), header, moment=7, page_rows=page, file_pages=4)
    back = snapshot.read(spark, str(tmp_path), 7, page)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert snapshot.read_header(str(tmp_path), 7).box == 250.0
    assert snapshot.read_coordinates(spark, str(tmp_path), 7, page).columns == ["id", "x", "y", "z"]
    assert 0 < snapshot.read_sample(spark, str(tmp_path), 0.5, moment=7, page_rows=page).count() < n
    assert snapshot.read_corner(spark, str(tmp_path), 50.0, 7, page).count() < n
    assert back.rdd.getNumPartitions() == -(-n // page)


def test_missing_pages_are_an_error(spark, tmp_path):
    with open(tmp_path / "PMcrd.DAT", "wb") as f:
        f.write(snapshot.Header(ngrid=8, nparticles=10).pack())
    with pytest.raises(Exception, match="missing"):
        snapshot.read(spark, str(tmp_path), page_rows=4).count()


def test_gadget(spark, tmp_path):
    for part in range(2):
        pos = (np.arange(30, dtype="<f4") * 1000 + part).reshape(10, 3)
        vel = np.full((10, 3), 50.0, "<f4")
        head = struct.pack(snapshot.GADGET, 0, 10, 0, 0, 0, 0, *[0.0] * 6, 0.5, 1.0, 0, 0, 0, 20, 0, 0, 0, 0, 0, 2, 32000.0, 0.3, 0.7, 0.7, b"")
        head = head.ljust(256, b"\0")
        mark = lambda b: struct.pack("<i", len(b)) + b + struct.pack("<i", len(b))
        (tmp_path / f"gadget.{part}").write_bytes(mark(head) + mark(pos.tobytes()) + mark(vel.tobytes()))
    df = snapshot.read_gadget(spark, f"{tmp_path}/gadget.*", 32)
    assert df.count() == 20 and snapshot.check_gadget_counts(spark, f"{tmp_path}/gadget.*").first() == (20, 20)
    r = df.where("row = 1").orderBy("x").first()
    assert abs(r["x"] - 4.0) < 1e-5 and abs(r["vx"] - 50 * 0.5 * 32 / (100 * 32)) < 1e-6


def test_catalog_text(spark, tmp_path):
    rows = [[i + 0.5, 2.0, 3.0, 1.0, 1.0, 1.0, 1e12 + i, 1e12, 200.0, 100.0, 150.0 + i, i, 7.0, 100 + i, i % 2, 0.1, 0.2, 0.03, 10.0, 0.8, 0.6, 1.0, 0.0, 0.0] for i in range(20)]
    for part in range(2):
        body = "\n".join(" ".join(f"{x:.6g}" for x in r) for r in rows[part::2])
        (tmp_path / f"cat.{part}").write_text(" Header line\n A= 1.00 Step= 2\n X Y Z\n" + body + "\n")
    df = text.read_halos(spark, f"{tmp_path}/cat.*", 155.0)
    assert df.count() == 14 and df.where("is_distinct").count() == 7
    assert C.violations(df.withColumn("id", F.col("halo_no")), text.HALO_LIMITS).count() == 0
    out = str(tmp_path / "out")
    text.write_columns(df.select("x", "mbound"), out, rows_per_file=5)
    assert text.fields_of(text.lines_of(spark, out), ["x", "m"]).count() == 14


def test_spectra_text(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"pk.{i}").write_text("title\n a = 1\n bin k n P\n" + "\n".join(f"{b} {b / 10} {b + 1} {100.0 + i}" for b in range(5)))
    df = text.read_spectra(spark, f"{tmp_path}/pk.*").withColumnRenamed("n_modes", "n")
    m = C.ensemble_mean(df, "bin").collect()
    assert len(m) == 5 and all(abs(r["mean"] - 101) < 1e-9 for r in m)


def test_rockstar_and_timing(spark, tmp_path):
    (tmp_path / "r.list").write_text("#id m pid\n# comment\n1 1e12 -1\n2 2e12 1\n")
    rows = text.read_rockstar(spark, str(tmp_path / "r.list"), ["id", "m", "pid"]).orderBy("id").collect()
    assert [r["is_distinct"] for r in rows] == [True, False]
    head = " Ngrid    =          64 Npart    =      262144 Nthreads =           8\n  Step   Tot/min      Force       Move          Density      IO         Bias       BDM        Analysis     MG\n"
    (tmp_path / "t.log").write_text(head + "\n".join(f"{s:5d}" + "".join(f"{s + i / 10:13.4f}" for i in range(9)) for s in range(1, 4)) + "\n")
    rows = text.parse_timing(spark.read.text(str(tmp_path / "t.log"))).orderBy("step").collect()
    assert [r["step"] for r in rows] == [1, 2, 3]
    want = dict(zip("total force move density io bias halos analysis field".split(), (2 + i / 10 for i in range(9)), strict=True))
    assert {k: v for k, v in rows[1].asDict().items() if k != "step"} == want


def test_rockstar_with_a_long_header(spark, tmp_path):
    """63 lines of header, some of which read like numbers after a #."""
    (tmp_path / "r.list").write_text("".join(f"#{i} 1 2 3\n" for i in range(63)) + "7 1e12 -1\n8 3e12 7\n")
    rows = text.read_rockstar(spark, str(tmp_path / "r.list"), ["id", "m", "pid"]).orderBy("id").collect()
    assert [(r["id"], r["m"], r["is_distinct"]) for r in rows] == [(7, 1e12, True), (8, 3e12, False)]


def test_galaxies_text(spark, tmp_path):
    (tmp_path / "g.dat").write_text("mock\n box = 32\n x y z vx vy vz dens\n" + "\n".join(" ".join(f"{i + j / 8}" for j in range(7)) for i in range(4)))
    rows = text.read_galaxies(spark, str(tmp_path / "g.dat")).orderBy("x").collect()
    assert [tuple(r[c] for c in text.GALAXY_COLUMNS) for r in rows] == [tuple(i + j / 8 for j in range(7)) for i in range(4)]


def test_listed_tables(spark, tmp_path):
    """Realizations follow the list, not the names; only as many files as its first line tells are read."""
    for i, name in enumerate("zba"):
        (tmp_path / f"{name}.dat").write_text("t\n a\n b\n" + "\n".join(f"{b} {b / 10} {b + 1} {100.0 * (i + 1)}" for b in range(1, 4)))
    (tmp_path / "list.dat").write_text("2\nz.dat\nb.dat\na.dat\n")
    df = text.read_listed(spark, str(tmp_path / "list.dat"), text.SPECTRUM_COLUMNS[:4], {"bin", "n_modes"})
    assert {(r["realization"], r["pk"]) for r in df.collect()} == {(0, 100.0), (1, 200.0)} and df.count() == 6
    got = {r["bin"]: r["pk"] for r in text.corrected(df.where("realization = 0"), 2500.0, 3300.0, 1000.0).collect()}
    assert all(abs(got[b] - (100 / (1 - 0.667 * np.sin(b / 10 * 2500 / 6600) ** 2) - 15.625)) < 1e-9 for b in (1, 2, 3))
    (tmp_path / "b1").write_text("t\n a\n b\n c\n0.1 0.2 0.3 12 5.5\n0.1 0.2 0.4 13 6.5\n")
    (tmp_path / "blist").write_text("1\nb1\n")
    assert [(r["k3"], r["n"], r["b"]) for r in text.read_bispectra(spark, str(tmp_path / "blist")).orderBy("k3").collect()] == [(0.3, 12.0, 5.5), (0.4, 13.0, 6.5)]


def test_written_profiles_and_planes(spark, tmp_path):
    p = spark.createDataFrame([(1, s, s, float(s), s * 10.0, s + 0.5) for s in range(3)] + [(2, 0, 1, 1.0, 9.0, 0.5)], "halo long, shell long, n long, mass double, enclosed double, radius double")
    h = spark.createDataFrame([(1, 500.0), (2, 50.0)], "halo long, mvir double")
    text.write_profiles(p, h, str(tmp_path / "p"), 1.0)
    rows = spark.read.parquet(str(tmp_path / "p")).collect()
    assert [(r["halo"], [(x["shell"], x["enclosed"]) for x in r["shells"]]) for r in rows] == [(1, [(1, 10.0), (2, 20.0)])]
    planes = spark.createDataFrame([("xy", a, b, a * 10.0 + b) for a in (1, 2) for b in (1, 2, 3)], "plane string, a int, b int, dens double")
    text.write_projections(planes, str(tmp_path / "planes"))
    assert {(r["plane"], r["a"], tuple(r["dens"])) for r in spark.read.parquet(str(tmp_path / "planes")).collect()} == {("xy", 1, (11.0, 12.0, 13.0)), ("xy", 2, (21.0, 22.0, 23.0))}


def test_reformatted_catalog(spark, tmp_path):
    row = [0.5, 2.0, 3.0, 1.0, 1.5, 2.5, 1e12, 1.1e12, 200.0, 100.0, 150.0, 3, 7.0, 100, 0, 0.1, 0.2, 0.03, 10.0, 0.8, 0.6, 1.0, 0.0, 0.0]
    (tmp_path / "c").write_text("head\n" + " ".join(map(str, row)) + "\n")
    out = text.reformatted(text.read_halos(spark, str(tmp_path / "c")), 0.3, 1.0, 340.0, H.mass_ratio_at).first()
    want = {d: K.mass_at_overdensity(np.array([1.1e12]), np.array([7.0]), d / (340 * 0.3))[0] for d in (500, 200)}
    assert abs(out["m500c"] / want[500] - 1) < 1e-9 and abs(out["m200c"] / want[200] - 1) < 1e-9 and out["m500c"] < out["m200c"] and out["spin"] == 0.03


# a_init to sigma_v, then three redshifts and two bias parameters
SHORT = [0.0099, 4e-4, 0.13, 1000.5, 0.81, 0.7, 0.31, 0.69, 0.048, 1001, 2002, 1298302, 0.49, 7.5e10, 100.0, 0.0, 30.0, 0.5, 3, "2.5 1.0 0.0 !", 2, 0.25, 0.75]


def test_inputs(tmp_path):
    path = str(tmp_path / "Init.dat")
    new = text.Inputs.load(path)
    assert new == text.Inputs() == text.Inputs.load(path) and (new.box, new.n_grid, new.a_step, new.bias[9], new.csf_beta) == (1000.0, 2000, 4e-4, 1.0, -0.2)
    own = "Box = 250.5\nNrow = 64\nNgrid = 128\nsig8 = 0.9\nz_init = 49.0\nstep da = 1.0d-3\nz = 0.5\n#out = 2\n 1.50 0.50\nthr = 20\nV = 1.5\n#P = 1\nP = 0.75\n"
    own += "".join(f"flag = {i}   note = {i}\n" for i in range(9)) + "".join(f"x = {v}  0 - no, 1 - yes\n" for v in (1, 0, 5, 0, 1, 0, 7, 1e-9, 2, -1e-6, 1, 0, 2.0, 0.3, 0.01, 0.2, 1, 0, 4, 1.5, 0.25, 2, 1, 0.3, -0.4))
    got = text.Inputs.parse(own)
    assert (got.box, got.n_rows, got.a_step, got.redshifts, got.sigma_v, got.bias, got.halos, got.field_model, got.most_cycles) == (250.5, 64, 1e-3, [1.5, 0.5], 1.5, [0.75], 8, 5, 7)
    assert (got.fr_0, got.kmf_n, got.csf_beta, got.amplitude_mode) == (-1e-6, 4, -0.4, 1) and text.Inputs.parse(got.text()) == got
    assert text.parse_seeds(" Seeds:  1298302  137\n  55 1\n 77 2\n") == [(55, 1), (77, 2)]


def test_settings():
    short = ["Setup of a run", "RUN 7"] + [f"{v}   note {i}, with 5 words" for i, v in enumerate(SHORT)]
    s = text.Setup.parse("\n".join(short))
    assert (s.title, s.header, s.a_init, s.a_step, s.sigma, s.box, s.sigma8) == ("Setup of a run", "RUN 7", 0.0099, 4e-4, 0.13, 1000.5, 0.81)
    assert (s.omega_m, s.omega_l, s.n_rows, s.n_grid, s.seed, s.sigma_v) == (0.31, 0.69, 1001, 2002, 1298302, 0.5)
    assert s.redshifts == [2.5, 1.0, 0.0] and s.bias == [0.25, 0.75] and s.appended and (s.power, s.density, s.halos) == (1, 1, 0)
    rest = [21, 2, 1, 0, 1, 0, 1, 0, 1, "--- field", "T", "F", 3, "T", "F", "F", 9, "1.0d-8", "--- fr", 2, -1e-5, "--- dgp", "T", "F", 1.5, "--- sym", 0.4, 0.002, 0.3]
    rest += ["--- kmf", "F", "T", 4, 1.25, 0.15, "--- csf", 1, 2, 0.11, -0.21]
    whole = text.Setup.parse("\n".join(short + [f"{v}" if str(v).startswith("-") and "e" not in str(v) and "." not in str(v) else f"{v}  ! note" for v in rest]))
    assert (whole.checkpoint_steps, whole.save_snapshots, whole.halos, whole.field_on, whole.field_model, whole.most_cycles, whole.residual_limit) == (21, 2, 1, True, 3, 9, 1e-8)
    assert (whole.fr_n, whole.fr_0, whole.dgp_h0rc, whole.sym_beta, whole.kmf_born_infeld, whole.kmf_k0, whole.csf_beta) == (2, -1e-5, 1.5, 0.3, True, 1.25, -0.21)
    assert (whole.amplitude_mode, whole.reverse_phases, whole.appended) == (1, 0, False)
    assert text.Setup.parse(whole.text()) == whole
    with pytest.raises(ValueError):
        text.Setup.parse("a\nb\n0.1\n")
    f = text.FinderSettings.parse("! iVirial = 2\n   iVirial = 3 ! Abacus\n MinMass = 1e10 ! m\nunknown = 5 ! x\nnradp = 12 ! n\nNne = 4 ! n\nDLOGR = 0.5 ! r\ndlogp = 0.25 ! p\nRextern = 0.75 ! e\nSlope = 0.125 ! s\n")
    assert f == text.FinderSettings(3, 12, 4, 0.75, 0.125, 1e10, 0.5, 0.25) and f.letter == "A"
    d = text.FinderSettings()
    assert text.FinderSettings.parse(d.text()) == d and (d.shells, d.extension, d.slope, d.least_mass) == (30, 0.15, 0.2, 2.5e12)
    pairs, rows = text.parse_table("Om = 0.3\nsigma8 = 0.8\n" + "\n".join(f"{10 ** (x / 10)} {x + 1}" for x in range(5)))
    assert pairs == {"om": 0.3, "sigma8": 0.8} and len(rows) == 5
    with pytest.raises(ValueError):
        text.parse_table("1 1\n2 1\n3 1\n")
    assert text.parse_pairs("a = b = 4 ! c\nflag = .true.\nx = 1d3") == {"a = b": 4, "flag": True, "x": 1000.0}
