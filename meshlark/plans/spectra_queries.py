"""Queries of Fourier operators.  Transforms have SQL by sums of sines on small meshes, and so have their spectra."""

from __future__ import annotations

from math import pi

from pyspark.sql import functions as F

from meshlark.functions import cosmology
from meshlark.operators import catalog as C
from meshlark.operators import mesh as M
from meshlark.operators import spectra as S
from meshlark.plans.fixtures import N, cte, query, view
from meshlark.plans.mesh_queries import RSD, SMALL, corners_sql, density, deposit_sql, multi, nodes_sql, particles, picked, rounded, tidy

BOX = 250.0
TINY = 8

quarter = ", ".join(f"({a} - 1) * 0.25e0 + 1 AS {a}" for a in "xyz")
cte("particles8", f"SELECT id, {quarter} FROM particles", "particles")
cte("corners8", corners_sql("particles8", TINY, "id"), "particles8")
cte("mesh8", deposit_sql("particles8", TINY, "corners8"), "corners8")


def dft_ctes(name: str, mesh: str, n: int, by: str = "") -> None:
    """name: (by, i, j, k, re, im) of a mesh, an axis at a time."""
    lead = f"{by}, " if by else ""
    cte(f"sines{n}", f"SELECT a, b, cos({-2 * pi / n!r}e0 * ((a*b) % {n})) AS c, sin({-2 * pi / n!r}e0 * ((a*b) % {n})) AS s FROM (SELECT unnest(range(0, {n})) AS a) a_, (SELECT unnest(range(0, {n})) AS b) b_".replace("e-0", "e-0"))
    last = f"(SELECT {lead}i, j, k, val AS re, 0e0 AS im FROM {mesh})"
    for p, axis in enumerate("ijk"):
        others = ", ".join(c for c in "ijk" if c != axis)
        cte(f"{name}_{p}", f"SELECT {lead}{others}, b + 1 AS {axis}, sum(re*c - im*s)/{n} AS re, sum(re*s + im*c)/{n} AS im FROM {last} m JOIN sines{n} t ON m.{axis} - 1 = t.a GROUP BY {lead}{others}, b", *((mesh, f"sines{n}") if p == 0 else (f"{name}_{p - 1}",)))
        last = f"{name}_{p}"
    w = lambda c: f"least({c} - 1, {n} - ({c} - 1))"
    cte(name, f"SELECT {lead}sqrt(k2) AS k, kz2/k2 AS mu2, re*re + im*im AS amp FROM (SELECT {lead}re, im, CAST({w('i')}*{w('i')} + {w('j')}*{w('j')} + {w('k')}*{w('k')} AS DOUBLE) AS k2, CAST({w('k')}*{w('k')} AS DOUBLE) AS kz2 FROM {last}) q WHERE k2 > 0", last)


def power_sql(modes: str, by: str = "") -> str:
    lead = f"{by}, " if by else ""
    return (
        f"SELECT {lead}CAST(greatest(floor(k + 0.5e0), 1) AS BIGINT) AS bin, CAST(count(*) AS BIGINT) AS n_modes, avg(k) * {2 * pi / BOX!r}e0 AS k, avg(amp) * {BOX**3}e0 AS p0, "
        f"avg(amp * (1.5e0*mu2 - 0.5e0)) * 2.5e0 * {BOX**3}e0 AS p2 FROM {modes} GROUP BY {lead}2" if by else
        f"SELECT CAST(greatest(floor(k + 0.5e0), 1) AS BIGINT) AS bin, CAST(count(*) AS BIGINT) AS n_modes, avg(k) * {2 * pi / BOX!r}e0 AS k, avg(amp) * {BOX**3}e0 AS p0, "
        f"avg(amp * (1.5e0*mu2 - 0.5e0)) * 2.5e0 * {BOX**3}e0 AS p2 FROM {modes} GROUP BY 1"
    )


def tidy_power(lead: str = "", source: str = "", extra: str = "p2") -> str:
    p2 = f", {tidy('p2', 3)} AS p2" if extra else ""
    return f"SELECT {lead}bin, n_modes, {tidy('k')} AS k, {tidy('p0', 3)} AS p0{p2} FROM ({source}) q"


def tidy_spectrum(df, *lead: str, p2: bool = True):
    cols = [rounded(F.col("k")).alias("k"), rounded(F.col("p0"), 3).alias("p0"), *([rounded(F.col("p2"), 3).alias("p2")] if p2 else [])]
    return df.select(*lead, "bin", "n_modes", *cols)


dft_ctes("modes8", "mesh8", TINY)
dft_ctes("modes16", "mesh16", SMALL)


def mesh8(spark, d):
    return density(spark, d, TINY)


@query("F17_relational_dft", f"SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(k AS INTEGER) AS k, {tidy('re', 8)} + 0e0 AS re, {tidy('im', 8)} + 0e0 AS im FROM modes8_2", "modes8")
def f17(spark, d):
    return S.dft3(mesh8(spark, d), TINY).select("i", "j", "k", *[(rounded(F.col(c), 8) + 0.0).alias(c) for c in ("re", "im")])


@query("F02_fft", f"SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(k AS INTEGER) AS k, {tidy('re', 8)} + 0e0 AS re, {tidy('im', 8)} + 0e0 AS im FROM modes8_2", "modes8")
def f02(spark, d):
    """By pencils, as a mesh of any size."""
    return S.transform(mesh8(spark, d), TINY, whole=False).select("i", "j", "k", *[(rounded(F.col(c), 8) + 0.0).alias(c) for c in ("re", "im")])


@query("F01_fft_round_trip", f"SELECT i, j, k, {tidy('val')} + 0e0 AS val FROM mesh16", "mesh16")
def f01(spark, d):
    back = S.fft3(S.transform(density(spark, d, SMALL), SMALL), SMALL, inverse=True)
    return back.select("i", "j", "k", (rounded(F.col("re")) + 0.0).alias("val"))


@query("F03_power", tidy_power(source=power_sql("modes16")), "modes16")
def f03(spark, d):
    return tidy_spectrum(S.power(S.transform(density(spark, d, SMALL), SMALL), SMALL, BOX))


@query("F03_power_log", f"SELECT bin, n_modes, {tidy('k')} AS k, {tidy('p0', 3)} AS p0 FROM (SELECT CAST(floor(log10(k)/0.1e0) AS BIGINT) AS bin, CAST(count(*) AS BIGINT) AS n_modes, avg(k) * {2 * pi / BOX!r}e0 AS k, avg(amp) * {BOX**3}e0 AS p0 FROM modes16 GROUP BY 1) q", "modes16")
def f03_log(spark, d):
    return tidy_spectrum(S.power_log(S.transform(density(spark, d, SMALL), SMALL), SMALL, BOX, 0.1), p2=False)


@query("F04_shared_bins", f"SELECT CAST(bin AS BIGINT) AS bin, {tidy('sum(w)')} AS weight, {tidy(f'sum(w*amp)/sum(w) * {BOX**3}e0', 3)} AS p0 FROM (SELECT floor(k) + o AS bin, amp, CASE WHEN o = 0 THEN 1 - (k - floor(k)) ELSE k - floor(k) END AS w FROM modes16, (SELECT unnest([0, 1]) AS o) o_) q WHERE w > 0 GROUP BY 1", "modes16")
def f04(spark, d):
    p = S.power_shared(S.transform(density(spark, d, SMALL), SMALL), SMALL, BOX)
    return p.select("bin", rounded(F.col("weight")).alias("weight"), rounded(F.col("p0"), 3).alias("p0"))


dft_ctes("modes32", "mesh", N)
POWER32 = tidy_power("'linear' AS kind, ", power_sql("modes32"), "") + f" UNION ALL SELECT 'log' AS kind, bin, n_modes, {tidy('k')} AS k, {tidy('p0', 3)} AS p0 FROM (SELECT CAST(floor(log10(k)/0.02e0) AS BIGINT) AS bin, CAST(count(*) AS BIGINT) AS n_modes, avg(k) * {2 * pi / BOX!r}e0 AS k, avg(amp) * {BOX**3}e0 AS p0 FROM modes32 GROUP BY 1) r"


@query("F06_power_driver", POWER32, "modes32")
def f06(spark, d):
    """The power of the full mesh in real space, in linear and in log bins."""
    spectrum = S.transform(density(spark, d), N)
    linear, logs = S.power(spectrum, N, BOX).drop("p2"), S.power_log(spectrum, N, BOX)
    both = linear.select(F.lit("linear").alias("kind"), "*").unionByName(logs.select(F.lit("log").alias("kind"), "*"))
    return tidy_spectrum(both, "kind", p2=False)


for _a in "xyz":
    cte(f"rsd16_{_a}", "SELECT id, " + ", ".join(f"CASE WHEN ({c} - 1)*0.5e0 + 1 >= 17 THEN ({c} - 1)*0.5e0 - 15 ELSE ({c} - 1)*0.5e0 + 1 END AS {c}" for c in "xyz") + f" FROM rsd_{_a}", f"rsd_{_a}")
    cte(f"rsd16_corners_{_a}", corners_sql(f"rsd16_{_a}", SMALL, "id"), f"rsd16_{_a}")
    cte(f"rsd16_mesh_{_a}", deposit_sql(f"rsd16_{_a}", SMALL, f"rsd16_corners_{_a}"), f"rsd16_corners_{_a}")
    dft_ctes(f"rsd16_modes_{_a}", f"rsd16_mesh_{_a}", SMALL)


def redshift_power(spark, d):
    p = particles(spark, d)
    parts = [S.power(S.transform(M.deposit(M.rescale(M.redshift_space(p, axis, RSD, N), N, SMALL), SMALL), SMALL), SMALL, BOX).withColumn("axis", F.lit(axis)) for axis in (1, 2, 3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


RSD_SQL = " UNION ALL ".join(f"SELECT {axis} AS axis, q.* FROM ({power_sql(f'rsd16_modes_{a}')}) q" for axis, a in ((1, "x"), (2, "y"), (3, "z")))


@query("F05_quadrupole", f"SELECT axis, bin, n_modes, {tidy('k')} AS k, {tidy('p0', 3)} AS p0, {tidy('p2', 3)} AS p2 FROM ({RSD_SQL}) r", *(f"rsd16_modes_{a}" for a in "xyz"))
def f05(spark, d):
    return tidy_spectrum(redshift_power(spark, d), "axis")


@query("F07_mean_of_axes", f"SELECT bin, {tidy('avg(p0)', 3)} AS p0, {tidy('avg(p2)', 3)} AS p2 FROM ({RSD_SQL}) r GROUP BY bin", *(f"rsd16_modes_{a}" for a in "xyz"))
def f07(spark, d):
    return redshift_power(spark, d).groupBy("bin").agg(rounded(F.avg("p0"), 3).alias("p0"), rounded(F.avg("p2"), 3).alias("p2"))


cte("picked8", f"SELECT id, {quarter} FROM picked", "picked")
cte("picked_corners8", corners_sql("picked8", TINY, "id"), "picked8")
cte("picked_mesh8", deposit_sql("picked8", TINY, "picked_corners8"), "picked_corners8")
dft_ctes("picked_modes8", "picked_mesh8", TINY)


@query("F08_galaxy_power", tidy_power(source=power_sql("picked_modes8")), "picked_modes8")
def f08(spark, d):
    return tidy_spectrum(S.power(S.transform(M.deposit(M.rescale(picked(spark, d), N, TINY), TINY), TINY), TINY, BOX))


@query("F09_corrected_power", f"SELECT bin, n_modes, {tidy('k')} AS k, {tidy(f'p0 / (1 - 0.6667e0*sin(k*{BOX / (2 * SMALL)}e0)*sin(k*{BOX / (2 * SMALL)}e0)) - {BOX**3}e0/60000e0', 3)} AS p0 FROM ({power_sql('modes16')}) q", "modes16")
def f09(spark, d):
    p = S.power(S.transform(density(spark, d, SMALL), SMALL), SMALL, BOX)
    return tidy_spectrum(S.corrected(p, SMALL, BOX, 60000.0), p2=False)


dft_ctes("multi_modes", "multi", SMALL, "level")


def levels_power(spark, d):
    spectra = S.power(S.transforms(multi(spark, d), SMALL, "level"), SMALL, BOX, "level")
    times = F.pow(F.lit(2.0), F.col("level"))  # a level's box is smaller by this
    return spectra.withColumns({"k": F.col("k") * times, "p0": F.col("p0") / (times * times * times), "p2": F.col("p2") / (times * times * times)})


@query("F10_folded_power", f"SELECT CAST(level AS INTEGER) AS level, bin, n_modes, {tidy('k * (1 << CAST(level AS INTEGER))')} AS k, {tidy('p0 / (1 << CAST(3*level AS INTEGER))', 3)} AS p0 FROM ({power_sql('multi_modes', 'level')}) q", "multi_modes")
def f10(spark, d):
    return tidy_spectrum(levels_power(spark, d), "level", p2=False)


cte("folded", f"SELECT CAST(level AS INTEGER) AS level, bin, n_modes, k * (1 << CAST(level AS INTEGER)) AS k, p0 / (1 << CAST(3*level AS INTEGER)) AS p0 FROM ({power_sql('multi_modes', 'level')}) q", "multi_modes")
cte("stitch1", f"SELECT * FROM folded WHERE level = 1 AND bin <= {SMALL // 8 + 1}", "folded")
cte("stitch2", "SELECT f.* FROM folded f, (SELECT max(k) AS e FROM stitch1) s WHERE level = 2 AND k > e AND k <= 2.5e0 * e", "folded", "stitch1")
cte("stitch3", "SELECT f.* FROM folded f, (SELECT coalesce((SELECT max(k) FROM stitch2), (SELECT max(k) FROM stitch1)) AS e) s WHERE level = 3 AND k > e AND k <= 2.5e0 * e", "folded", "stitch1", "stitch2")


@query("F10_stitched_power", tidy_power("level, ", "SELECT * FROM stitch1 UNION ALL SELECT * FROM stitch2 UNION ALL SELECT * FROM stitch3", ""), "stitch3")
def f10_stitched(spark, d):
    """The spectra of the folded meshes, each where the one before ends."""
    return tidy_spectrum(C.stitch(levels_power(spark, d), 2.5, first_bins=SMALL // 8 + 1), "level", p2=False)


SUBS = 2
OWN = N // SUBS
cte("own_box", "SELECT id, " + " + ".join(f"CAST(floor(({a} - 1) / {OWN}e0) AS INTEGER) * {SUBS**p}" for p, a in enumerate("xyz")) + " AS sub, " + ", ".join(f"{a} - floor(({a} - 1) / {OWN}e0) * {OWN} AS {a}" for a in "xyz") + " FROM particles", "particles")
cte("own_corners", corners_sql("own_box", OWN, "sub"), "own_box")
cte("own_nodes", f"SELECT * FROM ({nodes_sql(OWN)}) n, (SELECT sub, count(*) AS total FROM own_box GROUP BY sub) t", "own_box")
cte("own_mesh", f"SELECT n.sub, n.i, n.j, n.k, coalesce(s.w, 0e0) * ({float(OWN**3)!r}e0 / total) - 1 AS val FROM own_nodes n LEFT JOIN (SELECT sub, i, j, k, sum(w) AS w FROM own_corners GROUP BY 1, 2, 3, 4) s ON n.sub = s.sub AND n.i = s.i AND n.j = s.j AND n.k = s.k", "own_nodes", "own_corners")
dft_ctes("own_modes", "own_mesh", OWN, "sub")


@query("F11_sub_box_power", f"SELECT sub, bin, n_modes, {tidy(f'k * {SUBS}')} AS k, {tidy(f'p0 / {SUBS**3}', 3)} AS p0, {tidy(f'p2 / {SUBS**3}', 3)} AS p2 FROM ({power_sql('own_modes', 'sub')}) q", "own_modes")
def f11(spark, d):
    """Power of each octant on a periodic mesh of its own, from one pass over the particles."""
    boxes = M.own_boxes(particles(spark, d), N, SUBS)
    return tidy_spectrum(S.power(S.transforms(boxes, OWN, "sub"), OWN, BOX / SUBS, "sub"), "sub")


cte("kernel8", f"SELECT x.a AS a, y.a AS b, z.a AS c, sum(cos({2 * pi / TINY!r}e0 * ((x.a*p.a + y.a*q.a + z.a*r.a) % {TINY})) / (2*(cos({2 * pi / TINY!r}e0*p.a) + cos({2 * pi / TINY!r}e0*q.a) + cos({2 * pi / TINY!r}e0*r.a)) - 6)) / {TINY**3} AS g FROM eight x, eight y, eight z, eight p, eight q, eight r WHERE p.a + q.a + r.a > 0 GROUP BY 1, 2, 3", "eight")
cte("eight", f"SELECT unnest(range(0, {TINY})) AS a")


@query("F12_potential", f"SELECT CAST(x.a + 1 AS INTEGER) AS i, CAST(y.a + 1 AS INTEGER) AS j, CAST(z.a + 1 AS INTEGER) AS k, {tidy('sum(m.val * g)', 7)} + 0e0 AS val FROM eight x, eight y, eight z, mesh8 m JOIN kernel8 n ON true WHERE n.a = (x.a - m.i + 1 + {TINY}) % {TINY} AND n.b = (y.a - m.j + 1 + {TINY}) % {TINY} AND n.c = (z.a - m.k + 1 + {TINY}) % {TINY} GROUP BY 1, 2, 3", "eight", "mesh8", "kernel8")
def f12(spark, d):
    return S.potential(mesh8(spark, d), TINY).select("i", "j", "k", (rounded(F.col("val"), 7) + 0.0).alias("val"))


def field(spark, fixed=False, reverse=False):
    return S.random_field(spark, SMALL, BOX, cosmology.power_law(F.col("k")), seed=7, fixed=fixed, reverse=reverse)


@query("F13_random_field")
def f13(spark, d):
    return field(spark)


@query("F14_displacements")
def f14(spark, d):
    return S.displacements(field(spark), SMALL)


@query("F15_zeldovich")
def f15(spark, d):
    return S.zeldovich(S.displacements(field(spark), SMALL), SMALL, 0.5, 1.0)


@query("F16_fixed_amplitudes")
def f16(spark, d):
    """All amplitudes at their expectation, and the pair with opposite phases."""
    one, two = field(spark, fixed=True), field(spark, fixed=True, reverse=True)
    return one.withColumn("pair", F.lit(1)).unionByName(two.withColumn("pair", F.lit(2)))


@query("N08_transfer", f"SELECT i, CASE WHEN k <= {pi}e0 THEN {tidy('sqrt(k / (1 + k*k*k*k))')} ELSE 0e0 END AS t FROM (SELECT bin AS i, CAST(bin AS DOUBLE)/8e0 AS k FROM (SELECT DISTINCT bin FROM pk_realizations) q) r", "pk_realizations")
def n08(spark, d):
    """The square root of the power below a mesh's highest wave number, and 0 above."""
    k = view(spark, d, "pk_realizations").select(F.col("bin").alias("i"), (F.col("bin").cast("double") / 8.0).alias("k")).distinct()
    return k.select("i", cosmology.cut_root(F.col("k") / (1 + F.col("k") * F.col("k") * F.col("k") * F.col("k")), F.col("k"), pi, rounded).alias("t"))
