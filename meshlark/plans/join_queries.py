"""Queries of range joins on the halos view, each with brute-force SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshlark.operators import rangejoin as R
from meshlark.plans.fixtures import N, cte, query, view
from meshlark.plans.mesh_queries import rounded, tidy, whole

BOX = float(N)
EDGES = [0.25, 0.5, 1.0, 1.5, 2.0]


def halos(spark, d):
    return view(spark, d, "halos")


def image(c: str) -> str:
    x = f"(b.{c} - a.{c})"
    return f"(CASE WHEN {x} > {BOX / 2} THEN {x} - {BOX} WHEN {x} < -{BOX / 2} THEN {x} + {BOX} ELSE {x} END)"


D2 = " + ".join(f"{image(c)}*{image(c)}" for c in "xyz")
OPEN = " + ".join(f"(b.{c} - a.{c})*(b.{c} - a.{c})" for c in "xyz")
BIN = "CAST(" + " + ".join(f"CASE WHEN d2 >= {e * e}e0 THEN 1 ELSE 0 END" for e in EDGES) + " AS BIGINT)"
# heavy halos only: the SQL side compares all pairs
cte("heavy", "SELECT * FROM halos WHERE m > 60000", "halos")
cte("pairs", f"SELECT a.id AS a, b.id AS b, a.m * b.m AS w, {D2} AS d2 FROM heavy a JOIN heavy b ON a.id <> b.id AND {D2} < 4e0", "heavy")
cte("pair_bins", f"SELECT {BIN} AS bin, {whole('count(*)')} AS pairs, sum(w) AS weight FROM pairs GROUP BY 1", "pairs")


def heavy(spark, d):
    return halos(spark, d).where("m > 60000")


@query("J01_cells", "SELECT id, CAST(floor(x/2e0) AS INTEGER) AS ci, CAST(floor(y/2e0) AS INTEGER) AS cj, CAST(floor(z/2e0) AS INTEGER) AS ck FROM halos", "halos")
def j01(spark, d):
    return R.cells(halos(spark, d), 2.0, 16).select("id", "ci", "cj", "ck")


@query("J02_probed_cells", "SELECT id, CAST((floor(x/2e0) + p + 16) % 16 AS INTEGER) AS ci FROM halos, (SELECT unnest([-1, 0, 1]) AS p) q WHERE floor(x/2e0) + p BETWEEN floor((x-r)/2e0) AND floor((x+r)/2e0)", "halos")
def j02(spark, d):
    h = halos(spark, d).withColumns({"y": F.lit(1.0), "z": F.lit(1.0)})
    return R.probes(h, F.col("r"), 2.0, 16).select("id", "ci", "cj", "ck").select("id", "ci").distinct()


shifts = ", ".join(f"(SELECT unnest([-{BOX}e0, 0e0, {BOX}e0]) AS s{c}) s{c}_" for c in "xyz")
inside = " AND ".join(f"{c} + s{c} >= -2 AND {c} + s{c} < {BOX + 2}" for c in "xyz")
cte("ghosts", f"SELECT id, x + sx AS x, y + sy AS y, z + sz AS z, m, (sx <> 0 OR sy <> 0 OR sz <> 0) AS is_ghost FROM halos, {shifts} WHERE {inside}", "halos")


@query("J03_ghosts", "SELECT * FROM ghosts", "ghosts")
def j03(spark, d):
    return R.ghosts(halos(spark, d), BOX, 2.0).select("id", "x", "y", "z", "m", "is_ghost")


@query("J04_without_ghosts", "SELECT id, x, y, z, m FROM halos", "halos")
def j04(spark, d):
    return R.drop_ghosts(R.ghosts(halos(spark, d), BOX, 2.0)).select("id", "x", "y", "z", "m")


@query("J05_pair_counts", "SELECT * FROM pair_bins", "pair_bins")
def j05(spark, d):
    return R.pair_counts(heavy(spark, d), BOX, EDGES)


DV = "CASE bin " + " ".join(f"WHEN {i + 1} THEN {4 * 3.141592653589793 / 3 * (b**3 - a**3)!r}e0" for i, (a, b) in enumerate(zip(EDGES, EDGES[1:], strict=False))) + " END"


@query("K03_correlation", f"SELECT bin, pairs, {tidy('pairs / (n*n*dv) - 1', 4)} AS xi, {tidy('weight / (w*w*dv) - 1', 4)} AS xi_weighted FROM (SELECT *, {DV} / {BOX**3}e0 AS dv FROM pair_bins WHERE bin BETWEEN 1 AND {len(EDGES) - 1}) p, (SELECT CAST(count(*) AS DOUBLE) AS n, sum(m) AS w FROM heavy) t", "pair_bins", "heavy")
def k03(spark, d):
    return R.correlation(heavy(spark, d), BOX, EDGES).select("bin", "pairs", rounded(F.col("xi"), 4).alias("xi"), rounded(F.col("xi_weighted"), 4).alias("xi_weighted"))


ALONE = f"SELECT id, x, y, z, r, m FROM halos a WHERE NOT EXISTS (SELECT 1 FROM halos b WHERE a.m < b.m AND {OPEN} < b.r*b.r)"


@query("J07_remove_contained", ALONE, "halos")
def j07(spark, d):
    return R.remove_contained(halos(spark, d), BOX, 2.0).select("id", "x", "y", "z", "r", "m")


@query("J08_remove_contained_theta", ALONE.replace("halos", "heavy"), "heavy")
def j08(spark, d):
    return R.remove_contained_simple(heavy(spark, d)).select("id", "x", "y", "z", "r", "m")


@query("J09_distinct_flag", f"SELECT id, NOT EXISTS (SELECT 1 FROM halos b WHERE a.m < b.m AND {D2} < a.r*a.r) AS is_distinct FROM halos a", "halos")
def j09(spark, d):
    return R.distinct_flag(halos(spark, d), BOX, 2.0).select("id", "is_distinct")


means = ", ".join(f"avg({image(c)}) AS d{c}" for c in "xyz") + ", " + ", ".join(f"avg(b.v{c}) AS w{c}" for c in "xyz")
back = ", ".join(tidy(f"CASE WHEN x{c} >= {BOX} THEN x{c} - {BOX} WHEN x{c} < 0 THEN x{c} + {BOX} ELSE x{c} END") + f" AS {c}" for c in "xyz")
J06 = (
    f"SELECT id, {back}, " + ", ".join(f"{tidy(f'coalesce(w{c}, 0e0)')} AS v{c}" for c in "xyz") + f", {whole('coalesce(n, 0)')} AS n FROM (SELECT h.id, "
    + ", ".join(f"coalesce(h.{c} + d{c}, h.{c}) AS x{c}" for c in "xyz")
    + f", wx, wy, wz, n FROM heavy h LEFT JOIN (SELECT a.id, {means}, count(*) AS n FROM heavy a JOIN heavy b ON {D2} < 1e0 GROUP BY a.id) q ON h.id = q.id) s"
)


@query("J06_recentre", J06, "heavy")
def j06(spark, d):
    h = heavy(spark, d)
    out = R.recentre(h, h, 1.0, BOX, 1.0)
    return out.select("id", *[rounded(F.col(c)).alias(c) for c in ("x", "y", "z", "vx", "vy", "vz")], "n")


REACH = "greatest(0.5e0, least(2e0, log10(a.density + 10) / 2))"
cte("settle0", "SELECT id, x, y, z, m / 1000e0 AS density FROM heavy", "heavy")
for _p in range(1, 5):
    _wrapped = ", ".join(f"CASE WHEN x{c} >= {BOX} THEN x{c} - {BOX} WHEN x{c} < 0 THEN x{c} + {BOX} ELSE x{c} END AS {c}" for c in "xyz")
    cte(
        f"settle{_p}",
        f"SELECT id, density, {_wrapped}, wx, wy, wz, n FROM (SELECT h.id, h.density, " + ", ".join(f"coalesce(h.{c} + d{c}, h.{c}) AS x{c}" for c in "xyz")
        + f", q.wx, q.wy, q.wz, q.n FROM settle{_p - 1} h LEFT JOIN (SELECT a.id, {means}, count(*) AS n FROM settle{_p - 1} a JOIN heavy b ON {D2} < {REACH} * {REACH} GROUP BY a.id HAVING count(*) >= 2) q ON h.id = q.id) s",
        f"settle{_p - 1}", "heavy",
    )


@query("J06_settled_centres", "SELECT id, " + ", ".join(f"{tidy(c)} AS {c}" for c in "xyz") + ", " + ", ".join(f"{tidy(f'coalesce(w{c}, 0e0)')} AS v{c}" for c in "xyz") + f", {whole('coalesce(n, 0)')} AS n FROM settle4", "settle4")
def j06_settled(spark, d):
    """Four passes, each to the mean of the points within a reach that grows with the density."""
    h = heavy(spark, d)
    out = R.settle(h.withColumn("density", F.col("m") / 1000.0), h, 1.0, BOX)
    return out.select("id", *[rounded(F.col(c)).alias(c) for c in ("x", "y", "z", "vx", "vy", "vz")], "n")
