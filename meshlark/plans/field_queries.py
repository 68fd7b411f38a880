"""Queries of scalar fields, random numbers, tables of the background, and text parsing."""

from __future__ import annotations

from math import pi

import numpy as np
from pyspark.sql import functions as F

from meshlark.functions import cosmology, random
from meshlark.plans.fixtures import cte, query, view
from meshlark.plans.mesh_queries import SMALL, density, exact, near_sql, rounded, tidy
from meshlark.operators import mesh as M
from meshlark.operators import spectra as S
from meshlark.sources import text
from meshlark.streaming import blocks, relax

G, MASS, Q = 0.125, 0.5, 0.25
near = near_sql("state16", M.OFFSETS_6, SMALL).replace("val AS near", "u AS near")
cte("state16", "SELECT i, j, k, val AS rho, 1e0 + (i*7 + j*3 + k) % 5 / 8e0 AS u FROM mesh16_q", "mesh16_q")


def state(spark, d):
    u = 1.0 + F.pmod(F.col("i") * 7 + F.col("j") * 3 + F.col("k"), F.lit(5)) / 8.0
    return exact(density(spark, d, SMALL)).select("i", "j", "k", F.col("val").alias("rho"), u.alias("u"))


P = f"({G}e0*rho + {MASS}e0 - s/6)"


@query("X01_red_sweep", f"SELECT m.i, m.j, m.k, rho, {tidy(f'CASE WHEN (m.i+m.j+m.k) % 2 = 1 THEN (-{P} + sqrt({P}*{P} + 4*{Q}e0))/2 ELSE u END', 8)} AS u FROM state16 m JOIN (SELECT i, j, k, sum(near) AS s FROM ({near}) q GROUP BY i, j, k) g ON m.i = g.i AND m.j = g.j AND m.k = g.k", "state16")
def x01(spark, d):
    return relax.sweep_quadratic(state(spark, d), SMALL, 1, G, MASS, Q).withColumn("u", rounded(F.col("u"), 8))


@query("X02_residual", f"SELECT {tidy(f'sqrt(avg(r*r))', 8)} AS rms, CAST(count(*) AS BIGINT) AS n FROM (SELECT s/6 - u - {G}e0*rho - {MASS}e0 + {Q}e0/u AS r FROM state16 m JOIN (SELECT i, j, k, sum(near) AS s FROM ({near}) q GROUP BY i, j, k) g ON m.i = g.i AND m.j = g.j AND m.k = g.k) t", "state16")
def x02(spark, d):
    return relax.residual_quadratic(state(spark, d), SMALL, G, MASS, Q).select(rounded(F.col("rms"), 8).alias("rms"), "n")


def solved(model, kind):
    def run(spark, d):
        return relax.scalar_field(density(spark, d, SMALL), SMALL, model, kind)

    return run


for _name, _model, _kind in (
    ("X07_field_fr_v_cycle", relax.CurvatureGravity(cells=SMALL), "V"),
    ("X08_field_dgp_f_cycle", relax.BraneWorld(), "F"),
    ("X09_field_symmetron_w_cycle", relax.Symmetron(cells=SMALL), "W"),
    ("X01_field_kmouflage", relax.KineticScreening(cells=SMALL), "V"),
    ("X01_field_coupled_scalar", relax.CoupledScalar(cells=SMALL), "V"),
    ("X01_field_fr_n1", relax.CurvatureGravity(n=1, cells=SMALL), "V"),
    ("X01_field_fr_n2", relax.CurvatureGravity(n=2, cells=SMALL), "V"),
):
    query(_name)(solved(_model, _kind))


FR = relax.CurvatureGravity(cells=SMALL, f0=-1e-4)
LEVEL = blocks.Level(SMALL, 8)


def operator_sql(fields: str, n: int, dx: float) -> str:
    """L u of the quadratic model over fields (i, j, k, rho, u)."""
    g, m, q = (repr(x) + ("" if "e" in repr(x) else "e0") for x in FR.factors(dx))
    around = near_sql(fields, M.OFFSETS_6, n).replace("val AS near", "u AS near")
    return f"SELECT m.i, m.j, m.k, rho, u, (s - 6*u - {g}*rho - {m} + {q}/u) / {dx * dx}e0 AS lu FROM {fields} m JOIN (SELECT i, j, k, sum(near) AS s FROM ({around}) o GROUP BY i, j, k) a ON m.i = a.i AND m.j = a.j AND m.k = a.k"


cte("fr16", "SELECT i, j, k, val AS rho, 0.001e0 * (1e0 + (i*7 + j*3 + k) % 5 / 8e0) AS u FROM mesh16_q", "mesh16_q")
cte("fr16_l", operator_sql("fr16", SMALL, 1.0), "fr16")
HALVED = "SELECT CAST((i + 1) // 2 AS INTEGER) AS i, CAST((j + 1) // 2 AS INTEGER) AS j, CAST((k + 1) // 2 AS INTEGER) AS k, avg(rho) AS rho, avg(u) AS u, avg(-lu) AS r FROM fr16_l GROUP BY 1, 2, 3"
cte("fr8", HALVED, "fr16_l")
cte("fr8_l", operator_sql("fr8", SMALL // 2, 2.0), "fr8")


@query("X03_restricted_residual", f"SELECT l.i, l.j, l.k, {tidy('r * 1e3', 6)} AS residual, {tidy('(lu + r) * 1e3', 6)} AS wanted FROM fr8_l l JOIN fr8 f ON l.i = f.i AND l.j = f.j AND l.k = f.k", "fr8", "fr8_l")
def x03(spark, d):
    """By blocks: the residual restricted, and what is wanted of the level below (X04)."""
    own = exact(density(spark, d, SMALL))
    u = 0.001 * (1.0 + F.pmod(F.col("i") * 7 + F.col("j") * 3 + F.col("k"), F.lit(5)) / 8.0)
    state = blocks.of_mesh(own, LEVEL, 0.0).drop("u").join(blocks.of_mesh(own.select("i", "j", "k", u.alias("val")), LEVEL, 0.0).select("b", F.col("rho").alias("u")), "b")
    out = blocks.restricted_residual(state, LEVEL, FR)
    return out.select("i", "j", "k", *[rounded(F.col(c) * 1e3).alias(c) for c in ("residual", "wanted")])


SOLVED = {"fr": relax.CurvatureGravity(cells=SMALL), "brane": relax.BraneWorld(), "symmetron": relax.Symmetron(cells=SMALL), "kinetic": relax.KineticScreening(cells=SMALL), "coupled": relax.CoupledScalar(cells=SMALL)}


@query("X05_solved_fields", " UNION ALL ".join(f"SELECT '{m}' AS model, CAST({SMALL**3} AS BIGINT) AS n, 0e0 AS rms FROM (SELECT count(*) FROM region) r" for m in SOLVED))
def x05(spark, d):
    """Of each model's solved field the rms residual, rounded to 1e-6: the equation holds at all nodes."""
    mesh, out = density(spark, d, SMALL), None
    for name, model in SOLVED.items():
        field = relax.scalar_field(mesh, SMALL, model, "V")
        row = field.agg(F.lit(name).alias("model"), F.count(F.lit(1)).alias("n"), rounded(F.sqrt(F.avg(F.col("residual") * F.col("residual")))).alias("rms"))
        out = row if out is None else out.unionByName(row)
    return out


@query("X12_fifth_force", f"SELECT m.i, m.j, m.k, m.val + 0.5e0 * (s.u*s.u) AS val FROM mesh16_q m JOIN state16 s ON m.i = s.i AND m.j = s.j AND m.k = s.k", "mesh16_q", "state16")
def x12(spark, d):
    return relax.add_fifth_force(exact(density(spark, d, SMALL)), state(spark, d).select("i", "j", "k", F.col("u").alias("val")), 0.5, 2)


@query("X13_background")
def x13(spark, d):
    return spark.createDataFrame(relax.background(0.3, -0.1, 0.1), "a double, phi double, dphi double, h double")


@query("S28_field_slice", "SELECT k, val FROM mesh16 WHERE i = 8 AND j = 8", "mesh16")
def s28(spark, d):
    """Values along one axis through the middle."""
    return density(spark, d, SMALL).where((F.col("i") == 8) & (F.col("j") == 8)).select("k", "val")


RATE3 = "pow(x * sqrt(0.3e0 / (x*x*x) + 0.7e0), -3e0)"


@query("N04_growth", f"""SELECT a, {tidy('2.5e0 * 0.3e0 * sqrt(0.3e0 / (a*a*a) + 0.7e0) * s')} AS growth, {tidy('2 / (3 * sqrt(0.7e0)) * asinh(sqrt(0.7e0 / 0.3e0) * pow(a, 1.5e0))')} AS age FROM (SELECT a, sum(w * CASE WHEN x > 0 THEN {RATE3} ELSE 0e0 END) * a / 6000 AS s FROM
(SELECT i / 20e0 AS a, i / 20e0 * j / 2000 AS x, CASE WHEN j = 0 OR j = 2000 THEN 1 WHEN j % 2 = 1 THEN 4 ELSE 2 END AS w FROM (SELECT unnest(range(1, 21)) AS i) i_, (SELECT unnest(range(0, 2001)) AS j) j_, (SELECT count(*) FROM region) r) q GROUP BY a) t""")
def n04(spark, d):
    """The growth factor by quadrature, and the age, which in a flat universe has a closed form."""
    c = cosmology.Cosmology()
    rows = [(a / 20, cosmology.growth(c, a / 20), cosmology.age(c, a / 20)) for a in range(1, 21)]
    return spark.createDataFrame(rows, "a double, g double, t double").select("a", rounded(F.col("g")).alias("growth"), rounded(F.col("t")).alias("age"))


RHS = lambda y0, y1, n: f"(-(2 - 0.9e0 / exp(3 * ({n})) / (2 * (0.3e0 / exp(3 * ({n})) + 0.7e0))) * ({y1}) + 0.45e0 / exp(3 * ({n})) / (0.3e0 / exp(3 * ({n})) + 0.7e0) * ({y0}))"


@query("N05_growth_equation", f"""WITH RECURSIVE walk AS (SELECT i / 4e0 AS a, ln(1e-4) AS n, (ln(i / 4e0) - ln(1e-4)) / 500 AS h, 1e-4 AS y0, 1e-4 AS y1, 0 AS step FROM (SELECT unnest(range(1, 5)) AS i) i_, (SELECT count(*) FROM region) r UNION ALL
  SELECT a, n + h, h, y0 + h/6 * (y1 + 2*b1 + 2*c1 + d1), y1 + h/6 * (a2 + 2*b2 + 2*c2 + {RHS('y0 + h*c1', 'd1', 'n + h')}), step + 1 FROM (SELECT *, y1 + h*c2 AS d1 FROM (SELECT *, {RHS('y0 + h/2*b1', 'c1', 'n + h/2')} AS c2 FROM (SELECT *, y1 + h/2*b2 AS c1 FROM (SELECT *, {RHS('y0 + h/2*y1', 'b1', 'n + h/2')} AS b2 FROM (SELECT *, y1 + h/2*a2 AS b1 FROM (SELECT *, {RHS('y0', 'y1', 'n')} AS a2 FROM walk WHERE step < 500) k1) k2) k3) k4) k5) k6)
SELECT a, {tidy('y0')} AS growth FROM walk WHERE step = 500""")
def n05(spark, d):
    """The growth factor by steps of Runge and Kutta, 500 from a = 1e-4."""
    c = cosmology.Cosmology()
    rows = [(a / 4, cosmology.growth_ode(c, a / 4, 500)) for a in range(1, 5)]
    return spark.createDataFrame(rows, "a double, g double").select("a", rounded(F.col("g")).alias("growth"))


@query("N07_spectrum_table")
def n07(spark, d):
    """A grid of wave numbers with the normalised spectrum, as a run's setup writes it."""
    c = cosmology.Cosmology()
    k = tuple(10 ** (x / 20 - 4) for x in range(120))
    p = cosmology.normalised(c, cosmology.PowerTable(k, tuple(2e4 * (x / 0.02) / (1 + (x / 0.02) ** 2) ** 1.25 for x in k)))
    return spark.createDataFrame(list(zip(p.k, p.p, strict=True)), "k double, p double")


@query("R02_normal_numbers")
def r02(spark, d):
    return view(spark, d, "halos").select("id", S.normal(F.col("id"), 3).alias("g"))


NEXT = f"(({{s}}) * {random.MULTIPLIER} + {random.INCREMENT}) % {random.MODULUS}"


@query("R01_sequential_numbers", f"WITH RECURSIVE walk AS (SELECT 0 AS n, CAST(1298302 AS BIGINT) AS s UNION ALL SELECT n + 1, {NEXT.format(s='s')} FROM walk WHERE n < (SELECT least(count(*), 2000) FROM orders)) SELECT CAST(n AS BIGINT) AS n, s AS state, s / 2147483648e0 AS x FROM walk WHERE n > 0")
def r01(spark, d):
    """Numbers of the sequential generator, each by a jump to its place."""
    n = view(spark, d, "halos").select((F.col("id") + 1).alias("n")).where("n <= 2000")
    return n.select("n", random.sequential_state(1298302, F.col("n")).alias("state"), random.sequential(1298302, F.col("n")).alias("x"))


FIVE = "1.5491933e0 * (sum(x) - 2.5e0)"


@query("R01_sequential_normals", f"WITH RECURSIVE walk AS (SELECT 0 AS n, CAST(77 AS BIGINT) AS s UNION ALL SELECT n + 1, {NEXT.format(s='s')} FROM walk WHERE n < 1000) SELECT g AS n, {tidy('x * (1 - 0.01e0 * (3 - x*x))', 8)} AS x FROM (SELECT CAST((n - 1) // 5 + 1 AS BIGINT) AS g, {FIVE} AS x FROM (SELECT n, s / 2147483648e0 AS x FROM walk WHERE n > 0) w GROUP BY 1) q, (SELECT count(*) FROM region) r")
def r01_normals(spark, d):
    n = spark.range(1, 201).select(F.col("id").alias("n"))
    return n.select("n", rounded(random.sequential_normal(77, F.col("n")), 8).alias("x"))


def jumps(bits: int = 12) -> str:
    """A state after m steps, a bit of m in each nested query."""
    q = f"SELECT n, one AS s, 2357 + CAST(trunc(CAST(one AS FLOAT) / CAST({random.MODULUS} AS FLOAT) * CAST(137 AS FLOAT)) AS BIGINT) + 1 AS m FROM (SELECT n, {NEXT.format(s='s')} AS one FROM walk WHERE n < 50) o"
    for b in range(bits):
        a, c = random._jump(1 << b)
        q = f"SELECT n, m, CASE WHEN (m >> {b}) & 1 = 1 THEN (s * {a} + {c}) % {random.MODULUS} ELSE s END AS s FROM ({q}) b{b}"
    return q


@query("R04_seed_table", f"WITH RECURSIVE walk AS (SELECT CAST(0 AS BIGINT) AS n, CAST(1298302 AS BIGINT) AS s UNION ALL SELECT n + 1, s FROM ({jumps()}) j) SELECT w.n, s AS seed FROM walk w, (SELECT count(*) FROM region) r WHERE w.n > 0")
def r04(spark, d):
    """Seeds far apart in the sequence, by jumps."""
    return spark.createDataFrame([(i + 1, s) for i, s in enumerate(random.seed_table(50))], "n long, seed long")


# ---- text: the driver's log as lines

cte("lines", "SELECT line, 'Ngrid = x = ' || CAST(line % 100 AS VARCHAR) || '.5' AS pair, ' The residual is equal to ' || CAST(line % 1000 AS VARCHAR) || '.25 after ' || CAST(iter AS VARCHAR) || ' V-cycles.' AS told, CAST(line AS VARCHAR) || ' ' || CAST(line % 7 AS VARCHAR) || '.5 ' || CAST(line % 5 AS VARCHAR) || 'e1' AS numbers FROM log", "log")


def lines(spark, d):
    s = lambda c: F.col(c).cast("string")
    own = view(spark, d, "log").withColumns({"h": F.col("line") % 100, "t": F.col("line") % 1000, "u": F.col("line") % 7, "v": F.col("line") % 5})
    return own.select(
        "line", F.concat(F.lit("Ngrid = x = "), s("h"), F.lit(".5")).alias("pair"), F.concat(F.lit(" The residual is equal to "), s("t"), F.lit(".25 after "), s("iter"), F.lit(" V-cycles.")).alias("told"),
        F.concat(s("line"), F.lit(" "), s("u"), F.lit(".5 "), s("v"), F.lit("e1")).alias("numbers"),
    )


@query("S16_after_last_equals", "SELECT line, CAST(trim(regexp_extract(pair, '=([^=]*)$', 1)) AS DOUBLE) AS value FROM lines", "lines")
def s16(spark, d):
    return lines(spark, d).select("line", text.after_last_equals(F.col("pair")).cast("double").alias("value"))


@query("S15_header_pair", "SELECT line, CAST(line % 100 AS DOUBLE) + 0.5e0 AS value FROM lines", "lines")
def s15(spark, d):
    return lines(spark, d).select("line", text.header_pair(F.col("pair"), "x").alias("value"))


@query("S30_residual_lines", "SELECT line, CAST(regexp_extract(told, 'equal to +([0-9.]+)', 1) AS DOUBLE) AS residual, CAST(regexp_extract(told, 'after +([0-9]+)', 1) AS BIGINT) AS cycles FROM lines", "lines")
def s30(spark, d):
    return text.parse_residuals(lines(spark, d).select("line", F.col("told").alias("value")))


@query("S09_catalog_columns", "SELECT line, CAST(line AS BIGINT) AS id, CAST(string_split(numbers, ' ')[2] AS DOUBLE) AS x, CAST(string_split(numbers, ' ')[3] AS DOUBLE) AS y FROM lines", "lines")
def s09(spark, d):
    """Columns of lines of numbers, as catalogs are read."""
    return text.fields_of(lines(spark, d).select("line", F.col("numbers").alias("value")), ["id", "x", "y"], {"id"})


@query("S22_catalog_selection", "SELECT id, m FROM halos WHERE m >= 20000 AND id % 40 >= 10", "halos")
def s22(spark, d):
    h = view(spark, d, "halos").withColumns({"mbound": F.col("m"), "npart": F.col("id") % 40})
    return text.select_for_catalog(h, 5000.0, 1000.0, 32.0).select("id", "m")


SINE = relax.CurvatureGravity(cells=SMALL, f0=-1e-4)
WAVE = f"(1e0 + 0.1e0 * sin((k - 0.5e0) / {SMALL}e0 * 8 * pi()))"


@query("S28_solved_slice", f"SELECT k, {tidy(f'{WAVE}', 4)} AS solved, {tidy(WAVE, 4)} AS analytic FROM (SELECT CAST(unnest(range(1, {SMALL + 1})) AS INTEGER) AS k) q, (SELECT count(*) FROM region) r")
def s28_solved(spark, d):
    """Along the third axis through the middle: the solved field over its background, beside the sine whose source is given."""
    g, m, q = SINE.factors(1.0)
    sine = lambda k: 1 + 0.1 * F.sin((k - 0.5) / SMALL * 8 * pi)
    p = lambda k: SINE.background * sine(k)
    k = F.col("k").cast("double")
    rho = (p(k + 1) + p(k - 1) - 2 * p(k) - m + q / p(k)) / g
    solved = relax.scalar_field(M.nodes(spark, SMALL).select("i", "j", "k", rho.alias("val")), SMALL, SINE, "V")
    line = solved.where((F.col("i") == SMALL // 2) & (F.col("j") == SMALL // 2))
    return line.select("k", rounded(F.col("val") / SINE.background, 4).alias("solved"), rounded(sine(k), 4).alias("analytic"))


@query("X06_first_levels", " UNION ALL ".join(f"SELECT {n} AS n, {s} AS side FROM (SELECT count(*) FROM region) r" for n, s in ((64, 64), (96, 96), (256, 64), (2000, 80))))
def x06(spark, d):
    """Sides of the first level's blocks: those that halve most often, up to 96 cells."""
    return spark.createDataFrame([(n, blocks.first_level(n).side) for n in (64, 96, 256, 2000)], "n int, side int")


@query("X14_adaptive_steps", f"SELECT t, {tidy('sin(CAST(t AS DOUBLE))', 5)} AS y FROM (SELECT CAST(unnest(range(1, 21)) AS INTEGER) AS t) q, (SELECT count(*) FROM region) r")
def x14(spark, d):
    """An oscillator by steps whose length follows the error."""
    rows = [(t, float(cosmology.adaptive_steps(lambda _, y: np.array([y[1], -y[0]]), 0.0, float(t), np.array([0.0, 1.0]), 1e-10)[-1][1][0])) for t in range(1, 21)]
    return spark.createDataFrame(rows, "t int, v double").select("t", rounded(F.col("v"), 5).alias("y"))
