"""Queries of halos and of time steps: heavy rows of the halos view among the particles."""

from __future__ import annotations

from math import pi

from pyspark.sql import functions as F

from meshlark.functions import cosmology
from meshlark.functions.storage import cut, scratch
from meshlark.operators import catalog as C
from meshlark.operators import halos as H
from meshlark.operators import mesh as M
from meshlark.operators import spectra as S
from meshlark.plans.file_queries import bisected, masses_sql
from meshlark.plans.fixtures import VIEWS, N, cte, query, view
from meshlark.plans.join_queries import BOX, image
from meshlark.plans.mesh_queries import SMALL, density, exact, particles, pdf_sql, rounded, tidy, whole
from meshlark.plans.spectra_queries import power_sql, tidy_power
from meshlark.sources import text
from meshlark.streaming import evolve as E

EDGES = [0.5, 0.75, 1.0, 1.5, 2.0, 3.0]
LEAST = 99000.0
STRENGTH = 0.0625

D2 = " + ".join(f"{image(c)}*{image(c)}" for c in "xyz")
SHELL = "CAST(" + " + ".join(f"CASE WHEN d2 >= {e * e}e0 THEN 1 ELSE 0 END" for e in EDGES) + " AS BIGINT)"
cte("points0", "SELECT id, x - 1 AS x, y - 1 AS y, z - 1 AS z, vx, vy, vz, mass FROM particles", "particles")
cte("centres", f"SELECT id, x, y, z FROM halos WHERE m > {LEAST}", "halos")
cte("inside", f"SELECT halo, id, {SHELL} AS shell, mass, dx, dy, dz, vx, vy, vz, d2 FROM (SELECT a.id AS halo, b.id, b.mass, {', '.join(f'{image(c)} AS d{c}' for c in 'xyz')}, b.vx, b.vy, b.vz, {D2} AS d2 FROM centres a JOIN points0 b ON {D2} < {EDGES[-1] ** 2}e0) q", "centres", "points0")
radius = "[" + ", ".join(f"{e}e0" for e in EDGES) + "]"
cte("shells", f"SELECT h.halo, h.shell, {whole('coalesce(s.n, 0)')} AS n, coalesce(s.mass, 0e0) AS mass, {radius}[h.shell + 1] AS radius FROM (SELECT halo, unnest(range(0, {len(EDGES)})) AS shell FROM (SELECT DISTINCT halo FROM inside) d) h LEFT JOIN (SELECT halo, shell, count(*) AS n, sum(mass) AS mass FROM inside GROUP BY 1, 2) s ON h.halo = s.halo AND h.shell = s.shell", "inside")
cte("profiles", "SELECT *, sum(mass) OVER (PARTITION BY halo ORDER BY shell) AS enclosed FROM shells", "shells")


def points0(spark, d):
    return particles(spark, d).withColumns({a: F.col(a) - 1 for a in "xyz"})


def inside(spark, d):
    return H.members(view(spark, d, "halos").where(F.col("m") > LEAST), points0(spark, d), EDGES, BOX)


def profiles(spark, d):
    return H.profiles(inside(spark, d), EDGES)


@query("H13_profiles", "SELECT halo, shell, n, mass, enclosed, radius FROM profiles", "profiles")
def h13(spark, d):
    return profiles(spark, d).select("halo", "shell", "n", "mass", "enclosed", "radius")


MEAN = "(SELECT sum(mass) FROM points0) / 32768e0"
cte("rho", f"SELECT *, enclosed / ({H.FOUR_PI_3!r}e0 * radius*radius*radius * (SELECT sum(mass) / 32768e0 FROM points0)) AS rho FROM profiles", "profiles", "points0")
cte("crossings", "SELECT * FROM (SELECT *, lead(rho) OVER w AS rho_out, lead(radius) OVER w AS r_out, lead(enclosed) OVER w AS m_out FROM rho WINDOW w AS (PARTITION BY halo ORDER BY shell)) q WHERE rho >= 1e0 AND rho_out < 1e0", "rho")
cte("radii", "SELECT d.halo, x.r AS rvir, x.m AS mvir FROM (SELECT DISTINCT halo FROM profiles) d LEFT JOIN (SELECT halo, max_by({'r': radius + (rho - 1e0)/(rho - rho_out)*(r_out - radius), 'm': enclosed + (rho - 1e0)/(rho - rho_out)*(m_out - enclosed)}, shell) AS x FROM crossings GROUP BY halo) c ON d.halo = c.halo", "profiles", "crossings")


def mean_density(spark, d) -> float:
    return points0(spark, d).agg(F.sum("mass")).first()[0] / BOX**3


def radii(spark, d):
    return H.overdensity_radius(profiles(spark, d), 1.0, mean_density(spark, d))


@query("H04_overdensity_radius", f"SELECT halo, {tidy('rvir')} AS rvir, {tidy('mvir')} AS mvir FROM radii", "radii")
def h04(spark, d):
    return radii(spark, d).select("halo", rounded(F.col("rvir")).alias("rvir"), rounded(F.col("mvir")).alias("mvir"))


@query("W03_threshold_crossing", f"SELECT halo, CAST(max(shell) AS BIGINT) AS shell FROM crossings GROUP BY halo", "crossings")
def w03(spark, d):
    from pyspark.sql import Window

    own = profiles(spark, d)
    r = F.col("radius")
    w = Window.partitionBy("halo").orderBy("shell")
    own = own.withColumn("rho", F.col("enclosed") / (H.FOUR_PI_3 * r * r * r * mean_density(spark, d))).withColumn("out", F.lead("rho").over(w))
    return own.where("rho >= 1 AND out < 1").groupBy("halo").agg(F.max("shell").alias("shell"))


@query("H05_extended_radius", f"SELECT halo, {tidy('rvir + 0.25e0 * least(0.5e0 / pow(rvir/0.25e0, 1.5e0), 0.75e0)')} AS r FROM radii", "radii")
def h05(spark, d):
    return radii(spark, d).select("halo", rounded(H.extended_radius(F.col("rvir"), 0.25, 0.5, 1.5)).alias("r"))


@query("W04_peak_velocity", f"SELECT halo, {tidy('x.v2')} AS v2max, x.radius AS rmax FROM (SELECT halo, max_by({{'v2': v2, 'radius': radius}}, (v2, -shell)) AS x FROM (SELECT *, sum(falls) OVER (PARTITION BY halo ORDER BY shell DESC) AS seen FROM (SELECT *, enclosed/radius AS v2, CASE WHEN enclosed/radius < lag(enclosed/radius) OVER (PARTITION BY halo ORDER BY shell DESC) THEN 1 ELSE 0 END AS falls FROM profiles) a) b WHERE seen = 0 GROUP BY halo) c", "profiles")
def w04(spark, d):
    return H.peak_velocity(profiles(spark, d)).select("halo", rounded(F.col("v2max")).alias("v2max"), "rmax")


cte("phis", f"SELECT *, -{STRENGTH}e0 * sum(term) OVER (PARTITION BY halo ORDER BY shell DESC) AS phi FROM (SELECT *, CASE WHEN lead(radius) OVER w IS NULL THEN enclosed/radius ELSE (enclosed + lead(enclosed) OVER w)/2 * (1/radius - 1/lead(radius) OVER w) END AS term FROM profiles WINDOW w AS (PARTITION BY halo ORDER BY shell)) q", "profiles")


@query("W05_potential", f"SELECT halo, shell, {tidy('phi', 5)} AS phi FROM phis", "phis")
def w05(spark, d):
    return H.potentials(profiles(spark, d), STRENGTH).select("halo", "shell", rounded(F.col("phi"), 5).alias("phi"))


@query("H06_bulk_velocity", "SELECT halo, " + ", ".join(f"{tidy(f'avg(v{a})')} AS w{a}" for a in "xyz") + " FROM inside GROUP BY halo", "inside")
def h06(spark, d):
    return H.bulk_velocities(inside(spark, d)).select("halo", *[rounded(F.col(f"w{a}")).alias(f"w{a}") for a in "xyz"])


cte("bound", "SELECT q.*, p.phi FROM (SELECT i.*, i.vx - b.wx AS ux, i.vy - b.wy AS uy, i.vz - b.wz AS uz FROM inside i JOIN (SELECT halo, avg(vx) AS wx, avg(vy) AS wy, avg(vz) AS wz FROM inside GROUP BY halo) b ON i.halo = b.halo) q JOIN phis p ON q.halo = p.halo AND q.shell = p.shell WHERE (ux*ux + uy*uy + uz*uz)/2 + phi <= 0", "inside", "phis")


def bound(spark, d):
    return H.bound_members(view(spark, d, "halos").where(F.col("m") > LEAST), points0(spark, d), EDGES, BOX, STRENGTH, columns=("halo", "id", "shell"))[0]


def bound_moments(spark, d):
    return H.bound_moments(view(spark, d, "halos").where(F.col("m") > LEAST), points0(spark, d), EDGES, BOX, STRENGTH)


@query("H07_bound_members", "SELECT halo, id, shell FROM bound", "bound")
def h07(spark, d):
    return bound(spark, d).select("halo", "id", "shell")


spins = {"lx": "dy*uz - dz*uy", "ly": "dz*ux - dx*uz", "lz": "dx*uy - dy*ux"}
tensor = {f"t{a}{b}": f"d{a}*d{b}" for i, a in enumerate("xyz") for b in "xyz"[i:]}
SUMS = {"v2": "ux*ux + uy*uy + uz*uz"} | {f"s{a}": f"d{a}" for a in "xyz"} | spins | tensor | {"r2": "d2"}
cte("sums", f"SELECT halo, count(*) AS n, sum(mass) AS mass, " + ", ".join(f"sum(mass*({x})) AS {k}" for k, x in SUMS.items()) + " FROM bound GROUP BY halo", "bound")


@query("A09_moments", f"SELECT halo, {whole('n')} AS n, mass, " + ", ".join(f"{tidy(k, 3)} AS {k}" for k in SUMS) + " FROM sums", "sums")
def a09(spark, d):
    return bound_moments(spark, d)[0].select("halo", "n", "mass", *[rounded(F.col(k), 3).alias(k) for k in SUMS])


@query("H08_properties", f"SELECT s.halo, {whole('n')} AS n, mass, {tidy('sqrt(sx*sx+sy*sy+sz*sz)/mass/rvir', 5)} AS xoff, {tidy(f'sqrt(lx*lx+ly*ly+lz*lz)/mass/(sqrt(2e0)*rvir*sqrt({STRENGTH}e0*mass/rvir))', 5)} AS spin, {tidy(f'v2/({STRENGTH}e0*mass*mass/rvir) - 1', 5)} AS virrat, {tidy('sqrt(r2/mass)', 5)} AS radrms FROM sums s JOIN radii r ON s.halo = r.halo WHERE rvir > 0", "sums", "radii")
def h08(spark, d):
    sums, profile = bound_moments(spark, d)
    radii_ = H.overdensity_radius(profile, 1.0, mean_density(spark, d))
    p = H.properties(sums, radii_, STRENGTH)
    return p.select("halo", "n", "mass", *[rounded(F.col(c), 5).alias(c) for c in ("xoff", "spin", "virrat", "radrms")])


# eigenvalues of the symmetric tensor in closed form: the mean of the diagonal, the spread around it, and an angle
cte("tensor", "SELECT *, (txx + tyy + tzz) / 3 AS q, sqrt(((txx - q)*(txx - q) + (tyy - q)*(tyy - q) + (tzz - q)*(tzz - q) + 2*(txy*txy + txz*txz + tyz*tyz)) / 6) AS p FROM sums", "sums")
cte("angles", "SELECT *, acos(least(greatest(((txx - q)*((tyy - q)*(tzz - q) - tyz*tyz) - txy*(txy*(tzz - q) - tyz*txz) + txz*(txy*tyz - (tyy - q)*txz)) / (2*p*p*p), -1e0), 1e0)) / 3 AS phi FROM tensor WHERE p > 0", "tensor")
cte("axes", f"SELECT halo, sqrt(greatest(3*q - e1 - e3, 0e0) / e1) AS ba, sqrt(greatest(e3, 0e0) / e1) AS ca FROM (SELECT halo, q, q + 2*p*cos(phi) AS e1, q + 2*p*cos(phi + {2 * pi / 3!r}e0) AS e3 FROM angles) a", "angles")


@query("H09_axis_ratios", f"SELECT halo, {tidy('ba', 3)} AS ba, {tidy('ca', 3)} AS ca FROM axes", "axes")
def h09(spark, d):
    out = H.axis_ratios(bound_moments(spark, d)[0]).where("ba IS NOT NULL AND NOT isnan(ba)")
    return out.select("halo", rounded(F.col("ba"), 3).alias("ba"), rounded(F.col("ca"), 3).alias("ca"))


over = "greatest(sqrt(s.r2 / s.mass) / r.rvir - 0.4e0, 0e0)"


@query("H09_steepened_axes", "SELECT a.halo, " + ", ".join(f"{tidy(f'pow({x}, 1 + 2 * {over} + pow({c}e0 * {over}, 3e0))', 3)} AS {x}" for x, c in (("ba", 5.7), ("ca", 5.5))) + " FROM axes a JOIN sums s ON a.halo = s.halo JOIN radii r ON a.halo = r.halo WHERE r.rvir > 0", "axes", "sums", "radii")
def h09_steepened(spark, d):
    """Ratios to powers that grow with the rms radius over the halo's."""
    sums, profile = bound_moments(spark, d)
    radii_ = H.overdensity_radius(profile, 1.0, mean_density(spark, d))
    sums = cut(sums)
    out = H.axis_ratios(sums).where("ba IS NOT NULL AND NOT isnan(ba)").join(sums.select("halo", "r2", "mass"), "halo").join(radii_.where("rvir > 0"), "halo")
    out = H.steepened(out, F.sqrt(F.col("r2") / F.col("mass")) / F.col("rvir"))
    return out.select("halo", rounded(F.col("ba"), 3).alias("ba"), rounded(F.col("ca"), 3).alias("ca"))


LOSS = 0.05


@query("H10_peak_and_radius", f"SELECT halo, {tidy(f'x.v2 / (1 - {LOSS}e0 / r)')} AS v2max, x.radius AS rmax FROM (SELECT halo, max_by({{'v2': v2, 'radius': radius}}, (v2, -shell)) FILTER (seen = 0) AS x, coalesce(max(radius) FILTER (falls = 1), min(radius)) AS r FROM (SELECT *, sum(falls) OVER (PARTITION BY halo ORDER BY shell DESC) AS seen FROM (SELECT *, enclosed/radius AS v2, CASE WHEN enclosed/radius < lag(enclosed/radius) OVER (PARTITION BY halo ORDER BY shell DESC) THEN 1 ELSE 0 END AS falls FROM profiles) a) b GROUP BY halo) c", "profiles")
def h10(spark, d):
    """The highest enclosed mass over radius, from outside in, with the loss by resolution made up for, and its radius."""
    return H.peak_and_radius(cut(profiles(spark, d)), LOSS).select("halo", rounded(F.col("v2max")).alias("v2max"), "rmax")


RATIO = "(0.2162166e0 * X / (ln(1 + X) - X / (1 + X)))"


@query("H11_concentration", f"WITH RECURSIVE src AS (SELECT id, (vcirc / 1000e0 + 0.5e0) * (vcirc / 1000e0 + 0.5e0) AS target FROM ({VIEWS['halos']}) s0), " + bisected("2.1626e0", "1e4", RATIO, "target", True, 80) + f" SELECT s.id, CASE WHEN s.target >= 1 THEN {tidy('x', 5)} END AS conc FROM src s JOIN roots r ON s.id = r.id")
def h11(spark, d):
    """Concentrations of the halos view's circular velocities over a thousand."""
    conc = H.concentration_of(F.col("vcirc") / 1000.0 + 0.5)
    return view(spark, d, "halos").select("id", conc.alias("c")).select("id", F.when(~F.isnan("c"), rounded(F.col("c"), 5)).alias("conc"))


@query("H16_mass_at_overdensity", masses_sql({"m500": 2.5, "m200": 1.0}, "h.m", 4))
def h16(spark, d):
    h = view(spark, d, "halos")
    return h.select("id", *[rounded(F.col("m") * H.mass_ratio_at("conc", F.lit(r)), 4).alias(n) for n, r in (("m500", 2.5), ("m200", 1.0))])


@query("H01_finder")
def h01(spark, d):
    """The whole chain, from peaks of the mesh to a catalog without contained halos."""
    top = M.peaks(density(spark, d, SMALL), 0.125, SMALL)
    centres = top.select((F.col("i") + SMALL * (F.col("j") + SMALL * F.col("k").cast("long"))).alias("id"), *[((F.col(c) - 1) * (N / SMALL)).alias(a) for c, a in zip("ijk", "xyz", strict=True)], F.col("val").alias("density"))
    return H.find(centres, points0(spark, d), EDGES, BOX, 1.0, mean_density(spark, d), STRENGTH)


# ---- time steps

cte("gradq", "SELECT i, j, k, sum(near*a)/2 AS gx, sum(near*b)/2 AS gy, sum(near*c)/2 AS gz FROM (SELECT (((i - a - 1) % 32) + 32) % 32 + 1 AS i, (((j - b - 1) % 32) + 32) % 32 + 1 AS j, (((k - c - 1) % 32) + 32) % 32 + 1 AS k, a, b, c, val AS near FROM mesh_q, (VALUES (-1,0,0),(1,0,0),(0,-1,0),(0,1,0),(0,0,-1),(0,0,1)) o(a, b, c)) s GROUP BY i, j, k", "mesh_q")
cte("forces", "SELECT c.id, -sum(c.w*g.gx) AS fx, -sum(c.w*g.gy) AS fy, -sum(c.w*g.gz) AS fz FROM corners c JOIN gradq g ON c.i = g.i AND c.j = g.j AND c.k = g.k GROUP BY c.id", "corners", "gradq")
kicked = {a: f"(p.v{a} + 0.5e0 * f.f{a})" for a in "xyz"}
drifted = ", ".join(f"CASE WHEN x{a} >= 33 THEN x{a} - 32 WHEN x{a} < 1 THEN x{a} + 32 ELSE x{a} END AS {a}" for a in "xyz")


@query("T02_leapfrog", f"SELECT id, {drifted}, vx, vy, vz FROM (SELECT p.id, " + ", ".join(f"p.{a} + 0.125e0 * {kicked[a]} AS x{a}, {kicked[a]} AS v{a}" for a in "xyz") + " FROM particles p JOIN forces f ON p.id = f.id) q", "particles", "forces")
def t02(spark, d):
    """Kick and drift in a potential that is the density itself, on which all numbers are exact."""
    p = particles(spark, d).select("id", "x", "y", "z", "vx", "vy", "vz")
    return E.move(p, exact(density(spark, d)), N, 0.5, 0.125)


@query("T03_energies", "SELECT sum(vx*vx + vy*vy + vz*vz)/2 AS ekin, CAST(count(*) AS BIGINT) AS n FROM particles", "particles")
def t03(spark, d):
    return E.energies(particles(spark, d))


@query("T04_schedule", f"WITH RECURSIVE s(step, a, da) AS (SELECT CAST(0 AS BIGINT), 0.0625e0, 0.001953125e0 UNION ALL SELECT step + 1, a + da, CASE WHEN da < 0.0625e0/1.25e0*a AND a < 0.3e0 THEN da*1.5e0 ELSE da END FROM s WHERE a + da < 1e0) SELECT step, {tidy('a', 8)} AS a, {tidy('da', 8)} AS da FROM s")
def t04(spark, d):
    rows = E.schedule(0.0625, 0.001953125, 0.0625)
    return spark.createDataFrame(rows, "step long, a double, da double").select("step", rounded(F.col("a"), 8).alias("a"), rounded(F.col("da"), 8).alias("da"))


def started(spark):
    field = S.random_field(spark, SMALL, 250.0, cosmology.power_law(F.col("k")), seed=7)
    return S.zeldovich(S.displacements(field, SMALL), SMALL, 0.2, 0.2)


@query("T01_evolution")
def t01(spark, d):
    """Two steps from initial conditions."""
    return E.run(started(spark), SMALL, E.Clock(0.1, 0, 0.01), 2, 0.3)[0]


@query("T06_analysis", f"SELECT 'power' AS kind, bin, n_modes AS n, p0 AS value FROM ({tidy_power('', power_sql('modes32'), '')}) p UNION ALL SELECT 'density', bin, n, rho FROM ({pdf_sql('mesh')}) d", "modes32", "mesh")
def t06(spark, d):
    """Power and distribution of density, from one mesh."""
    out = E.analyse(particles(spark, d), N, 250.0)
    return out["power"].select(F.lit("power").alias("kind"), "bin", F.col("n_modes").alias("n"), rounded(F.col("p0"), 3).alias("value")).unionByName(out["density"].select(F.lit("density").alias("kind"), "bin", "n", rounded(F.col("rho")).alias("value")))


Z, COUNT, WIDTH = (2.5, 1.0, 0.5), 150, 60
AWAY = ", ".join(f"coalesce(min(CASE WHEN was > {z}e0 AND z <= {z}e0 THEN least(was - {z}e0, {z}e0 - z) END), 1e3) AS d{i}" for i, z in enumerate(Z))


@query("O07_schedule_search", f"""WITH RECURSIVE grid AS (SELECT 0.008e0 + i * 0.0005e0 AS a0, 0.0001e0 + j * 0.00001e0 AS da0 FROM (SELECT unnest(range(0, 20)) AS i) i_, (SELECT unnest(range(0, 20)) AS j) j_, (SELECT count(*) FROM region) r),
walk AS (SELECT a0, da0, 0 AS n, a0 AS a, da0 AS da FROM grid UNION ALL SELECT a0, da0, n + 1, a + nd, nd FROM (SELECT *, CASE WHEN da < da0 / a0 / 1.25e0 * a AND a < 0.5e0 THEN 1.5e0 * da ELSE da END AS nd FROM walk WHERE a <= 1) q),
steps AS (SELECT a0, da0, n, 1 / a - 1 AS z, lag(1 / a - 1) OVER (PARTITION BY a0, da0 ORDER BY n) AS was FROM walk WHERE n > 0),
tried AS (SELECT a0, da0, CAST(max(n) AS BIGINT) AS steps, {AWAY} FROM steps GROUP BY a0, da0)
SELECT {tidy('a0', 8)} AS a, {tidy('da0', 8)} AS da, steps, {tidy('error', 5)} AS error FROM (SELECT *, d0 / 0.02e0 + d1 / 0.01e0 + d2 / 0.0003e0 + 10 * exp(pow((steps - {COUNT}) / {WIDTH}e0, 2)) AS error FROM tried WHERE steps > {COUNT - WIDTH} AND steps < {COUNT + WIDTH} AND a0 > 0.005e0 AND a0 < 0.02e0) q ORDER BY error, a0, da0 LIMIT 1""")
def o07(spark, d):
    """Of a grid of starts and first steps, the one whose steps come nearest to three redshifts in about 150 steps."""
    grid = spark.range(400).select((0.008 + F.floor(F.col("id") / 20) * 0.0005).alias("a"), (0.0001 + F.col("id") % 20 * 0.00001).alias("da"))
    best = E.tune(grid, Z, COUNT, WIDTH)
    return best.select(rounded(F.col("a"), 8).alias("a"), rounded(F.col("da"), 8).alias("da"), "steps", rounded(F.col("error"), 5).alias("error"))


@query("N02_sigma_of_mass")
def n02(spark, d):
    """sigma(M) and its slope for the mean masses of the mass function's bins."""
    c = cosmology.Cosmology()
    k = [10 ** (x / 20 - 4) for x in range(120)]
    table = cosmology.normalised(c, cosmology.PowerTable(tuple(k), tuple(2e4 * (x / 0.02) / (1 + (x / 0.02) ** 2) ** 1.25 for x in k)))

    def run(batches):
        for b in batches:
            b["sigma"] = [cosmology.sigma_mass(c, table, 1e10 * m) for m in b["mass_mean"]]
            b["slope"] = [cosmology.log_slope(c, table, 1e10 * m) for m in b["mass_mean"]]
            yield b

    bins = C.mass_function(view(spark, d, "halos"), 0.25, 32768.0).select("bin", "n", "mass_mean")
    return bins.mapInPandas(run, "bin long, n long, mass_mean double, sigma double, slope double")


KEPT = 5.0


@query("S23_written_profiles", f"SELECT h.halo, CAST(p.shell AS BIGINT) AS shell, p.radius, p.n, p.enclosed FROM (SELECT halo FROM radii WHERE mvir > {100 * KEPT}e0) h JOIN profiles p ON h.halo = p.halo WHERE p.n > 0 AND p.enclosed > {5 * KEPT}e0", "radii", "profiles")
def s23(spark, d):
    """Profiles of well-sampled halos, written a row a halo and read."""
    own, path = cut(profiles(spark, d)), scratch(spark)
    radii_ = H.overdensity_radius(own, 1.0, mean_density(spark, d))
    text.write_profiles(own, radii_, path, KEPT)
    return spark.read.parquet(path).select("halo", F.inline("shells")).select("halo", "shell", "radius", "n", "enclosed")


@query("T05_resumed_state", "SELECT id, x + 1 AS x, y + 1 AS y, z + 1 AS z, vx, vy, vz, 0.25e0 AS a, 12 AS step FROM halos", "halos")
def t05(spark, d):
    """A state saved and resumed, with its clock."""
    path = scratch(spark)
    points = view(spark, d, "halos").select("id", *[(F.col(a) + 1).alias(a) for a in "xyz"], "vx", "vy", "vz")
    E.save(points, E.Clock(0.25, 12, 0.01), path)
    back, clock = E.resume(spark, path)
    return back.withColumns({"a": F.lit(clock.a), "step": F.lit(clock.step)})
