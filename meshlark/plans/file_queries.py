"""Queries of readers and writers: the halos view is written in a format and read again, so its rows are the answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshlark.functions import cosmology
from meshlark.functions.storage import scratch
from meshlark.operators import halos as H
from meshlark.operators import mesh as M
from meshlark.plans.fixtures import N, query, view
from meshlark.plans.mesh_queries import SMALL, density, rounded, tidy, whole
from meshlark.sources import snapshot, text

PAGE, A = 512, 0.5
FACTOR = 0.25
COLUMNS = snapshot.COLUMNS
GRID = "id, x + 1 AS x, y + 1 AS y, z + 1 AS z, vx, vy, vz"


def particles(spark, d):
    """The halos as particles: coordinates from 1, and ids from 0 without gaps."""
    return view(spark, d, "halos").select("id", *[(F.col(a) + 1).alias(a) for a in M.AXES], "vx", "vy", "vz")


def written(spark, d, file_pages: int = 4, moment: int | None = 7) -> str:
    path = scratch(spark)
    header = snapshot.Header("halos as particles", aexpn=A, ngrid=N, nrow=25)
    header.extras[-1] = 250.0
    snapshot.write(particles(spark, d), path, header, moment, PAGE, file_pages)
    return path


@query("S01_snapshot_header", f"SELECT 'halos as particles' AS title, {A}e0 AS aexpn, {N} AS ngrid, 25 AS nrow, 250e0 AS box, {whole('count(*)')} AS nparticles FROM orders")
def s01_header(spark, d):
    h = snapshot.read_header(written(spark, d), 7)
    return spark.createDataFrame([(h.title, h.aexpn, h.ngrid, h.nrow, h.box, h.nparticles)], "title string, aexpn double, ngrid int, nrow int, box double, nparticles long")


@query("S02_snapshot", f"SELECT {GRID} FROM halos", "halos")
def s02(spark, d):
    """Pages written in several files of a numbered snapshot, and read (S01, S07)."""
    return snapshot.read(spark, written(spark, d), 7, PAGE)


@query("S03_initial_files", f"SELECT {GRID} FROM halos", "halos")
def s03(spark, d):
    """With the initial files' number of pages, and names without a moment."""
    return snapshot.read(spark, written(spark, d, snapshot.FILE_PAGES, None), None, PAGE)


@query("S04_snapshot_corner", f"SELECT id, " + ", ".join(f"{c} * {250 / N}e0 AS {c}" for c in "xyz") + ", " + ", ".join(f"v{c} * {100 * 250 / N / A}e0 AS v{c}" for c in "xyz") + f" FROM halos WHERE x * {250 / N}e0 < 125 AND y * {250 / N}e0 < 125 AND z * {250 / N}e0 < 125", "halos")
def s04(spark, d):
    return snapshot.read_corner(spark, written(spark, d), 125.0, 7, PAGE)


@query("S05_coordinates", "SELECT id, x + 1 AS x, y + 1 AS y, z + 1 AS z FROM halos", "halos")
def s05(spark, d):
    return snapshot.read_coordinates(spark, written(spark, d), 7, PAGE)


MOVED = f"(z + 1 + {FACTOR}e0 * vz)"


@query("S06_sampled_snapshot", f"SELECT id, x + 1 AS x, y + 1 AS y, CASE WHEN {MOVED} >= {N + 1} THEN {MOVED} - {N} WHEN {MOVED} < 1 THEN {MOVED} + {N} ELSE {MOVED} END AS z, vx, vy, vz FROM halos WHERE CAST((72421*109*id + 1349973) % 15485867 AS DOUBLE) / 15485867e0 < 0.25e0", "halos")
def s06(spark, d):
    """A quarter of the particles, in redshift space along the third axis."""
    return snapshot.read_sample(spark, written(spark, d), 0.25, FACTOR, 3, 7, PAGE)


BOX_MPC = 32.0


@query("S08_gadget", "SELECT id AS row, x + 1 AS x, y + 1 AS y, z + 1 AS z, vx * 0.005e0 AS vx, vy * 0.005e0 AS vy, vz * 0.005e0 AS vz FROM halos", "halos")
def s08(spark, d):
    """One Gadget file of the halos as dark matter, in kpc/h and km/s, read into grid units."""
    path = scratch(spark)
    snapshot.write_gadget(view(spark, d, "halos"), path, A, BOX_MPC)
    return snapshot.read_gadget(spark, f"{path}/gadget.*", N).drop("file")


def catalog(spark, d):
    """The halos view in a catalog's columns."""
    h = view(spark, d, "halos")
    zero = F.lit(0.0)
    given = {"mbound": F.col("m") * 1e10, "mtot": F.col("m") * 1.25e10, "rvir": F.col("r"), "vrms": zero, "halo_no": F.col("id"), "npart": F.col("id") % 100, "idist": F.col("is_sub").cast("long"), "radrms": zero, "ba": zero, "ca": zero, "xax": zero, "yax": zero, "zax": zero}
    return h.select(*[given.get(c, F.col(c) if c in h.columns else zero).alias(c) for c in text.HALO_COLUMNS])


@query("S09_catalog", "SELECT id AS halo_no, x, y, z, vx, m * 1e10 AS mbound, vcirc, conc, NOT is_sub AS is_distinct FROM halos WHERE vcirc > 155", "halos")
def s09(spark, d):
    """Written in parts with a header each (S13: all parts are read), of which slow halos are left out."""
    path = scratch(spark)
    text.write_columns(catalog(spark, d).repartition(3), path, "catalog of halos", rows_per_file=2000)
    return text.read_halos(spark, path, 155.0).select("halo_no", "x", "y", "z", "vx", "mbound", "vcirc", "conc", "is_distinct")


ROCK = ["id", "m", "vpeak", "x", "y", "z", "pid"]


@query("S10_rockstar", "SELECT id, m, x, is_sub = FALSE AS is_distinct FROM halos", "halos")
def s10(spark, d):
    """A list with comments, whose parent ids are negative for distinct halos."""
    path = scratch(spark)
    rows = view(spark, d, "halos").select("id", "m", F.col("vcirc").alias("vpeak"), "x", "y", "z", F.when(F.col("is_sub"), F.col("id") + 1).otherwise(-1).alias("pid"))
    text.write_columns(rows, path, "#" + " ".join(ROCK))
    return text.read_rockstar(spark, path, ROCK).select("id", "m", "x", "is_distinct")


@query("S11_rockstar_selected", "SELECT id, m, vcirc AS vpeak FROM halos WHERE m > 5000 AND vcirc > 500 AND x >= 0 AND x < 32 AND y >= 0 AND y < 32 AND z >= 0 AND z < 32", "halos")
def s11(spark, d):
    """With a long header; heavy and fast halos inside the box."""
    path = scratch(spark)
    rows = view(spark, d, "halos").select("id", "m", F.col("vcirc").alias("vpeak"), "x", "y", "z", F.lit(-1).alias("pid"))
    head = spark.createDataFrame([(f"#{i} 1 2 3 4 5 6 7",) for i in range(63)], "line string").coalesce(1)
    head.write.text(path)
    rows.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in ROCK]).alias("line")).write.mode("append").text(path)
    out = text.read_rockstar(spark, path, ROCK).where("m > 5000 AND vpeak > 500")
    return out.where(" AND ".join(f"{a} >= 0 AND {a} < 32" for a in "xyz")).select("id", "m", "vpeak")


@query("S12_galaxies", "SELECT x, y, z, vx, vy, vz, m / 1024e0 AS dens FROM halos", "halos")
def s12(spark, d):
    """A mock's galaxies, written (S24) and read."""
    path = scratch(spark)
    text.write_columns(view(spark, d, "halos").select("x", "y", "z", "vx", "vy", "vz", (F.col("m") / 1024.0).alias("dens")), path, "mock galaxies")
    return text.read_galaxies(spark, path).select("x", "y", "z", "vx", "vy", "vz", "dens")


@query("S14_power_table", "SELECT CAST(i AS DOUBLE) AS i, floor(pow(2e0, i / 8e0 - 10) * 1e9 + 0.5e0) / 1e9 AS k, 100e0 + i AS p, 0.3e0 AS omega_m FROM (SELECT DISTINCT l_partkey % 64 AS i FROM lineitem) q")
def s14(spark, d):
    """A table of power with a header of cosmology; its steps in ln k must be equal."""
    rows = sorted(r[0] for r in spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_partkey") % 64).distinct().collect())  # 64
    pairs, table = text.parse_table("Om = 0.3\nsigma8 = 0.8\n" + "\n".join(f"{2 ** (i / 8 - 10)!r} {100.0 + i}" for i in rows))
    return spark.createDataFrame([(float(i), k, p, pairs["om"]) for i, (k, p) in zip(rows, table, strict=True)], "i double, k double, p double, omega_m double").withColumn("k", rounded(F.col("k"), 9))


RUN_LINES = [0.0099, 4e-4, 0.13, 1000.5, 0.81, 0.7, 0.31, 0.69, 0.048, 1001, 2002, 1298302, 0.49, 7.5e10, 100.0, 0.0, 30.0, 0.5, 3, "2.5 1.0 0.0", 2, 0.25, 0.75]


@query("S17_setup", "SELECT 1000.5e0 AS box, 0.81e0 AS sigma8, 1001 AS n_rows, 2002 AS n_grid, 1298302 AS seed, 2.5e0 AS first_redshift, 20 AS checkpoint_steps, 1 AS amplitude_mode FROM (SELECT count(*) FROM region) r")
def s17(spark, d):
    """A positional file that ends before its outputs, which have their defaults."""
    s = text.Setup.parse("run\nheader\n" + "\n".join(f"{v} ! note" for v in RUN_LINES))
    row = (s.box, s.sigma8, s.n_rows, s.n_grid, s.seed, s.redshifts[0], s.checkpoint_steps, s.amplitude_mode)
    return spark.createDataFrame([row], "box double, sigma8 double, n_rows int, n_grid int, seed int, first_redshift double, checkpoint_steps int, amplitude_mode int")


@query("S18_finder_settings", "SELECT 'A' AS letter, 12 AS shells, 0.75e0 AS extension, 0.125e0 AS slope, 1e10 AS least_mass, 0.02e0 AS step_radius FROM (SELECT count(*) FROM region) r")
def s18(spark, d):
    s = text.FinderSettings.parse("iVirial = 3 ! kind\nnradp = 12 ! n\nRextern = 0.75 ! r\nSlope = 0.125 ! s\nMinMass = 1e10 ! m\nunknown = 1 ! x\n")
    return spark.createDataFrame([(s.letter, s.shells, s.extension, s.slope, s.least_mass, s.step_radius)], "letter string, shells int, extension double, slope double, least_mass double, step_radius double")


@query("S19_input_defaults", "SELECT 1000e0 AS box, 1000 AS n_rows, 2000 AS n_grid, 0.0004e0 AS a_step, 10 AS n_redshifts, 1e0 AS last_bias, -0.2e0 AS csf_beta FROM (SELECT count(*) FROM region) r")
def s19(spark, d):
    """A new input file, read again."""
    s = text.Inputs.parse(text.Inputs().text())
    return spark.createDataFrame([(s.box, s.n_rows, s.n_grid, s.a_step, len(s.redshifts), s.bias[-1], s.csf_beta)], "box double, n_rows int, n_grid int, a_step double, n_redshifts int, last_bias double, csf_beta double")


def listed(spark, d):
    """The spectra as a file a realization, and the list that names them."""
    path = scratch(spark)
    rows = view(spark, d, "pk_realizations").select("realization", "bin", ((F.col("bin") + 1) / 16.0).alias("k"), F.col("n").alias("n_modes"), F.col("pk").cast("double").alias("pk")).orderBy("realization", "bin").collect()  # 1024
    fs, base = snapshot.store(path)
    fs.create_dir(base, recursive=True)
    names = sorted({r["realization"] for r in rows})
    for i in names:
        with fs.open_output_stream(f"{base}/pk.{99 - i}.dat") as f:
            own = [" ".join(str(r[c]) for c in ("bin", "k", "n_modes", "pk")) for r in rows if r["realization"] == i]
            f.write("\n".join(["spectrum", "of a run", "bin k n pk", *own]).encode() + b"\n")
    with fs.open_output_stream(f"{base}/list.dat") as f:
        f.write("\n".join([f"{len(names)}", *[f"pk.{99 - i}.dat" for i in names]]).encode() + b"\n")
    return text.read_listed(spark, f"{path}/list.dat", text.SPECTRUM_COLUMNS[:4], {"bin", "n_modes"})


SIZE, MESH, ROWS = 250.0, 64.0, 50.0
DAMP = f"(1 - 0.667e0 * sin((bin + 1) / 16e0 * {SIZE / (2 * MESH)}e0) * sin((bin + 1) / 16e0 * {SIZE / (2 * MESH)}e0))"


@query("S20_corrected_spectra", f"SELECT CAST(realization AS BIGINT) AS realization, CAST(bin AS BIGINT) AS bin, {tidy(f'pk / {DAMP} - {(SIZE / ROWS) ** 3}e0', 4)} AS pk FROM pk_realizations", "pk_realizations")
def s20(spark, d):
    return text.corrected(listed(spark, d), SIZE, MESH, ROWS).select("realization", "bin", rounded(F.col("pk"), 4).alias("pk"))


@query("S21_listed_spectra", "SELECT CAST(realization AS BIGINT) AS realization, CAST(bin AS BIGINT) AS bin, (bin + 1) / 16e0 AS k, CAST(n AS BIGINT) AS n_modes, CAST(pk AS DOUBLE) AS pk FROM pk_realizations", "pk_realizations")
def s21(spark, d):
    """Realizations in the order of the list, which isn't that of the names."""
    return listed(spark, d).select("realization", "bin", "k", "n_modes", "pk")


@query("S25_particle_buffers", "SELECT x, y, z FROM halos WHERE CAST((72421*109*id + 1349973) % 15485867 AS DOUBLE) / 15485867e0 < 0.5e0", "halos")
def s25(spark, d):
    """A random half of the points in files of a bounded number of rows."""
    path = scratch(spark)
    text.write_columns(M.sample(view(spark, d, "halos"), 0.5).select("x", "y", "z"), path, "x y z of a sample", rows_per_file=1000)
    return text.fields_of(text.lines_of(spark, path), ["x", "y", "z"]).select("x", "y", "z")


@query("S26_projections", f"SELECT plane, a, b, {tidy('dens')} AS dens FROM (SELECT 'xy' AS plane, i AS a, j AS b, sum(val + 1)/{SMALL} AS dens FROM mesh16 GROUP BY i, j UNION ALL SELECT 'xz', i, k, sum(val + 1)/{SMALL} FROM mesh16 GROUP BY i, k UNION ALL SELECT 'yz', j, k, sum(val + 1)/{SMALL} FROM mesh16 GROUP BY j, k) q", "mesh16")
def s26(spark, d):
    """Three projections, written as rows of planes and read."""
    path = scratch(spark)
    text.write_projections(M.project(density(spark, d, SMALL), SMALL), path)
    rows = spark.read.parquet(path).select("plane", "a", F.posexplode("dens").alias("at", "dens"))
    return rows.select("plane", "a", (F.col("at") + 1).alias("b"), rounded(F.col("dens")).alias("dens"))


def bisected(low: str, high: str, ratio: str, target: str, rising: bool, steps: int) -> str:
    """Common table expression `roots` (id, x): where ratio(x) is the target, by halving; over src (id, target)."""
    f = ratio.replace("X", "((lo + hi) / 2)")
    up = f"{f} < {target}" if rising else f"{f} > {target}"
    return f"""walk AS (SELECT id, target, {low} AS lo, {high} AS hi, 0 AS step FROM src UNION ALL
  SELECT id, target, CASE WHEN {up} THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {up} THEN hi ELSE (lo + hi) / 2 END, step + 1 FROM walk WHERE step < {steps}),
roots AS (SELECT id, (lo + hi) / 2 AS x FROM walk WHERE step = {steps})"""


NFW = "(ln(1 + X) - X / (1 + X))"
CRITICAL = 500 / (340 * 0.3), 200 / (340 * 0.3)


def mass_sql(ratio: float, source: str, conc: str) -> str:
    f = NFW.replace("X", conc)
    return f"WITH RECURSIVE src AS (SELECT id, {ratio!r}e0 * {f} / ({conc}*{conc}*{conc}) AS target FROM ({source}) s0), " + bisected("1e-3", "1e3", f"({NFW} / (X*X*X))", "target", False, 100) + " SELECT id, x FROM roots"


def masses_sql(ratios: dict[str, float], mass: str, digits: int) -> str:
    from meshlark.plans.fixtures import VIEWS

    source = VIEWS["halos"]
    joins = " ".join(f"JOIN ({mass_sql(r, source, 'conc')}) {n} ON h.id = {n}.id" for n, r in ratios.items())
    cols = ", ".join(f"{tidy(mass + ' * ' + NFW.replace('X', f'{n}.x') + ' / ' + NFW.replace('X', 'h.conc'), digits)} AS {n}" for n in ratios)
    return f"SELECT h.id, {cols} FROM ({source}) h {joins}"


@query("S27_reformatted_catalog", masses_sql({"m500c": CRITICAL[0], "m200c": CRITICAL[1]}, "1.25e0 * h.m", 4))
def s27(spark, d):
    """Masses at 500 and 200 times the critical density, of catalogs whose own overdensity is 340 times the mean."""
    out = text.reformatted(catalog(spark, d).withColumn("spin", F.col("halo_no").cast("double")), 0.3, 1.0, 340.0, H.mass_ratio_at)
    return out.select(F.col("spin").cast("long").alias("id"), *[rounded(F.col(c) / 1e10, 4).alias(c) for c in ("m500c", "m200c")])


@query("S30_timing_lines", "SELECT CAST(line AS BIGINT) AS step, " + ", ".join(f"CAST((line + {i}) % 97 AS DOUBLE) + 0.25e0 AS {p}" for i, p in enumerate(text.PHASES)) + " FROM log", "log")
def s30(spark, d):
    """Lines of a timing log, a step's minutes by phase."""
    log = view(spark, d, "log")
    cells = [F.concat(((F.col("line") + i) % 97).cast("string"), F.lit(".2500")) for i in range(len(text.PHASES))]
    head = spark.createDataFrame([(" Ngrid = 64",), ("  Step  Tot/min Force",)], "value string")
    return text.parse_timing(head.unionByName(log.select(F.concat_ws("   ", F.col("line").cast("string"), *cells).alias("value"))))


@query("H03_scales", f"SELECT {tidy(f'0.3e0 * 2.774e11 * ({SIZE}e0 / 25) * ({SIZE}e0 / 25) * ({SIZE}e0 / 25) / 1e10')} AS particle_mass, {tidy(f'{SIZE}e0 / {N}')} AS length, {tidy(f'100 * {SIZE}e0 / {N} / {A}e0')} AS velocity, 0e0 AS low, {SIZE}e0 AS high FROM (SELECT count(*) FROM region) r")
def h03(spark, d):
    """Units of a snapshot of 25**3 particles: mass of a particle, length and velocity of a cell, and the domain."""
    s = cosmology.scales(cosmology.Cosmology(), SIZE, 25, N, A)
    row = spark.createDataFrame([(s["particle_mass"] / 1e10, s["length"], s["velocity"], s["domain"][0], s["domain"][1])], "particle_mass double, length double, velocity double, low double, high double")
    return row.withColumns({c: rounded(F.col(c)) for c in ("particle_mass", "length", "velocity")})
