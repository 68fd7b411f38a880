"""Queries of catalog and ensemble statistics, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from meshlark.operators import catalog as C
from meshlark.plans.fixtures import VIEWS, cte, query, view
from meshlark.plans.mesh_queries import rounded, tidy, whole

VOLUME = 32768.0


def halos(spark, d):
    return view(spark, d, "halos")


def rms_sql(v: str) -> str:
    return tidy(f"sqrt(greatest(avg({v}*{v}) - avg({v})*avg({v}), 0e0))", 5)


RELAXED = "xoff < 0.075e0 AND spin < 0.1e0 AND virrat < 1.5e0"


@query("P07_relaxed_halos", f"SELECT id, m, vcirc, xoff FROM halos WHERE m > 1000 AND {RELAXED} AND NOT is_sub", "halos")
def p07(spark, d):
    return halos(spark, d).where(f"m > 1000 AND {RELAXED} AND NOT is_sub").select("id", "m", "vcirc", "xoff")


LIMITS = {"m": (10.0, 100000.0), "vcirc": (60.0, 1990.0), "conc": (1.0, 24.0)}


@query("P08_violations", " UNION ALL ".join(f"SELECT id, '{c}' AS \"column\", {c} AS value FROM halos WHERE {c} < {a!r}e0 OR {c} > {b!r}e0 OR {c} IS NULL" for c, (a, b) in LIMITS.items()), "halos")
def p08(spark, d):
    return C.violations(halos(spark, d), LIMITS)


MASS_BIN = "CAST(floor(log10(m) / 0.25e0) AS BIGINT)"


@query("A04_binned_mean", f"SELECT {MASS_BIN} AS bin, {whole('count(*)')} AS n, {tidy('avg(conc)')} AS conc FROM halos GROUP BY 1", "halos")
def a04(spark, d):
    return halos(spark, d).groupBy(F.floor(F.log10("m") / 0.25).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("conc")).alias("conc"))


@query("A05_mean_and_rms", f"SELECT {MASS_BIN} AS bin, {whole('count(*)')} AS n, {tidy('avg(conc)', 5)} AS conc_mean, {rms_sql('conc')} AS conc_rms, {tidy('avg(xoff)', 5)} AS xoff_mean, {rms_sql('xoff')} AS xoff_rms FROM halos GROUP BY 1", "halos")
def a05(spark, d):
    out = C.binned_mean(halos(spark, d), F.floor(F.log10("m") / 0.25).cast("long"), "conc", "xoff")
    return out.select("bin", "n", *[rounded(F.col(c), 5).alias(c) for c in ("conc_mean", "conc_rms", "xoff_mean", "xoff_rms")])


@query("A07_component_distribution", " UNION ALL ".join(f"SELECT 'v{a}' AS axis, CAST(floor(v{a}/0.5e0) AS BIGINT) AS bin, {whole('count(*)')} AS n FROM halos GROUP BY 2" for a in "xyz"), "halos")
def a07(spark, d):
    return C.component_distribution(halos(spark, d), 0.5)


@query("A08_distinct_and_sub", f"SELECT {MASS_BIN} AS bin, CAST(count(*) FILTER (NOT is_sub) AS BIGINT) AS n_distinct, CAST(count(*) FILTER (is_sub) AS BIGINT) AS n_sub, coalesce(sum(m) FILTER (is_sub), 0e0) AS m_sub FROM halos GROUP BY 1", "halos")
def a08(spark, d):
    b = F.floor(F.log10("m") / 0.25).cast("long").alias("bin")
    return halos(spark, d).groupBy(b).agg(F.count_if(~F.col("is_sub")).alias("n_distinct"), F.count_if("is_sub").alias("n_sub"), F.coalesce(F.sum(F.when(F.col("is_sub"), F.col("m"))), F.lit(0.0)).alias("m_sub"))


V_BIN = "CAST(floor(vcirc / 50e0) AS BIGINT)"


@query("W01_cumulative", f"SELECT bin, n, CAST(sum(n) OVER (ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS above FROM (SELECT {V_BIN} AS bin, {whole('count(*)')} AS n FROM halos GROUP BY 1) q", "halos")
def w01(spark, d):
    return C.cumulative_above(halos(spark, d).groupBy(C.linear_bin(F.col("vcirc"), 50.0).alias("bin")).agg(F.count(F.lit(1)).alias("n")))


@query("W07_trimmed_bins", f"SELECT CAST(b AS BIGINT) AS bin, {whole('coalesce(n, 0)')} AS n FROM (SELECT unnest(range(lo, hi + 1)) AS b FROM (SELECT min(bin) AS lo, max(bin) AS hi FROM (SELECT CAST(floor(m/5000e0) AS BIGINT)*3 AS bin FROM halos) a) e) r LEFT JOIN (SELECT CAST(floor(m/5000e0) AS BIGINT)*3 AS bin, count(*) AS n FROM halos GROUP BY 1) q ON r.b = q.bin", "halos")
def w07(spark, d):
    b = (F.floor(F.col("m") / 5000.0) * 3).cast("long").alias("bin")
    return C.dense_bins(halos(spark, d).groupBy(b).agg(F.count(F.lit(1)).alias("n")))


@query("O01_rank", "SELECT id, vcirc, CAST(row_number() OVER (ORDER BY vcirc, id) AS BIGINT) AS rank FROM halos", "halos")
def o01(spark, d):
    return C.global_rank(halos(spark, d).select("id", "vcirc"), "vcirc")


def quantiles_sql(value: str, by: str, source: str) -> str:
    names = [n.split(" AS ")[-1] for n in by.split(", ")]
    keys = ", ".join(names)
    cols = ", ".join(f"max({value}) FILTER (rk = floor({q}e0 * n) + 1) AS q{round(100 * q)}" for q in C.QUANTILES)
    return f"SELECT {keys}, {whole('n')} AS n, {cols} FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {value}, id) AS rk, count(*) OVER (PARTITION BY {keys}) AS n FROM (SELECT id, {value}, {by} FROM {source}) a) b WHERE n > 10 GROUP BY {keys}, n"


@query("O02_quantiles", quantiles_sql("conc", f"{MASS_BIN} AS bin", "halos"), "halos")
def o02(spark, d):
    return C.bin_quantiles(halos(spark, d).withColumn("bin", F.floor(F.log10("m") / 0.25).cast("long")), "conc", "bin")


@query("O04_velocity_quantiles", quantiles_sql("vcirc", f"{MASS_BIN} AS bin, is_sub AS sub", "halos"), "halos")
def o04(spark, d):
    h = halos(spark, d).withColumn("bin", F.floor(F.log10("m") / 0.25).cast("long")).withColumn("sub", F.col("is_sub"))
    return C.bin_quantiles(h, "vcirc", "bin", "sub")


def adaptive(df):
    return C.adaptive_quantiles(df, F.floor(F.col("m") / 250.0), "conc", least=600)


def adaptive_sql(source: str) -> str:
    """Bins one after another: a state is a range of fine bins and a width, which widens until the range has 600 rows."""
    cols = ", ".join(f"max(conc) FILTER (rk = floor({q}e0 * n) + 1) AS q{round(100 * q)}" for q in C.QUANTILES)
    return f"""WITH RECURSIVE src AS (SELECT id, conc, CAST(floor(m / 250e0) AS BIGINT) AS fine FROM ({source}) s0),
fine AS (SELECT r.b, coalesce(c.n, 0) AS n FROM (SELECT unnest(range((SELECT min(fine) FROM src), (SELECT max(fine) FROM src) + 1)) AS b) r LEFT JOIN (SELECT fine, count(*) AS n FROM src GROUP BY fine) c ON r.b = c.fine),
one AS (SELECT list(n_to ORDER BY b) AS upto, min(b) AS first, max(b) AS last FROM (SELECT b, sum(n) OVER (ORDER BY b) AS n_to FROM fine) f),
walk AS (SELECT first AS lo, first AS hi, 1e0 AS width FROM one WHERE first IS NOT NULL
  UNION ALL SELECT CASE WHEN full_ THEN hi + 1 ELSE lo END, least(last, CASE WHEN full_ THEN hi + greatest(CAST(round(width) AS BIGINT), 1) ELSE lo + CAST(round(width * 1.5e0) AS BIGINT) - 1 END), CASE WHEN full_ THEN width ELSE width * 1.5e0 END
    FROM (SELECT w.*, o.last, (upto[hi - first + 1] - CASE WHEN lo > first THEN upto[lo - first] ELSE 0 END >= 600 OR hi >= last) AS full_ FROM walk w, one o) q WHERE NOT (full_ AND hi >= last)),
edges AS (SELECT lo AS low, max(hi) AS high FROM walk GROUP BY lo)
SELECT low, high, {whole('n')} AS n, {cols} FROM (SELECT *, row_number() OVER (PARTITION BY low ORDER BY conc, id) AS rk, count(*) OVER (PARTITION BY low) AS n FROM src JOIN edges ON fine BETWEEN low AND high) b WHERE n > 10 GROUP BY low, high, n"""


HALOS_SQL = VIEWS["halos"]


@query("O03_adaptive_bins", adaptive_sql(HALOS_SQL))
def o03(spark, d):
    return adaptive(halos(spark, d))


@query("O05_adaptive_bins_relaxed", adaptive_sql(f"SELECT * FROM ({HALOS_SQL}) h0 WHERE {RELAXED}"))
def o05(spark, d):
    return adaptive(halos(spark, d).where(RELAXED))


@query("O06_nearest_bin", "SELECT bin, k FROM (SELECT DISTINCT bin, (bin + 1) / 4e0 AS k FROM pk_realizations) q ORDER BY abs(k - 3.3e0), bin LIMIT 1", "pk_realizations")
def o06(spark, d):
    k = view(spark, d, "pk_realizations").select("bin", ((F.col("bin") + 1) / 4.0).alias("k")).distinct()
    return k.orderBy(F.abs(F.col("k") - 3.3), "bin").limit(1)


@query(
    "K01_mass_function",
    f"SELECT bin, n, {tidy('mass_mean', 4)} AS mass_mean, above, above / {VOLUME}e0 AS n_above, n / ({VOLUME}e0 * 0.25e0) AS dn_dbin FROM (SELECT *, CAST(sum(n) OVER (ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS above FROM (SELECT {MASS_BIN} AS bin, {whole('count(*)')} AS n, avg(m) AS mass_mean FROM halos GROUP BY 1) q) r",
    "halos",
)
def k01(spark, d):
    return C.mass_function(halos(spark, d), 0.25, VOLUME).withColumn("mass_mean", rounded(F.col("mass_mean"), 4))


SPEED = "sqrt(vx*vx + vy*vy + vz*vz)"


@query(
    "K02_velocity_function",
    f"SELECT bin, n, {tidy('speed_mean', 5)} AS speed_mean, above, above / {VOLUME}e0 AS n_above FROM (SELECT *, CAST(sum(n) OVER (ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS above FROM (SELECT CAST(floor({SPEED}) AS BIGINT) AS bin, {whole('count(*)')} AS n, avg({SPEED}) AS speed_mean FROM halos GROUP BY 1) q) r",
    "halos",
)
def k02(spark, d):
    return C.velocity_function(halos(spark, d), 1.0, VOLUME).withColumn("speed_mean", rounded(F.col("speed_mean"), 5))


# a tabulated function: 65 rows of (k, value) on the interval [0, 32]
cte("curve", "SELECT CAST(i AS DOUBLE)/2e0 AS k, CAST((i*i*37 + 11) % 1009 AS DOUBLE)/8e0 AS f FROM (SELECT unnest(range(0, 65)) AS i) q")


def curve(spark):
    i = F.col("id")
    return spark.range(65).select((i.cast("double") / 2.0).alias("k"), (((i * i * 37 + 11) % 1009).cast("double") / 8.0).alias("f"))


@query("J10_lookup", "SELECT h.id, h.x, a.f + (b.f - a.f) * ((h.x - a.k) / (b.k - a.k)) AS f FROM halos h JOIN curve a ON a.k = floor(h.x * 2e0) / 2e0 JOIN curve b ON b.k = a.k + 0.5e0", "halos", "curve")
def j10(spark, d):
    return C.lookup(halos(spark, d).select("id", "x"), curve(spark), "x", "k", "f")


@query("N01_table_interpolation", f"SELECT id, {tidy('f')} AS f FROM (SELECT h.id, CASE WHEN h.m < 2 THEN 1e0 ELSE a.f + (b.f - a.f) * ((log2(h.m) - a.k) / (b.k - a.k)) END AS f FROM halos h LEFT JOIN curve a ON a.k = floor(log2(h.m) * 2e0) / 2e0 LEFT JOIN curve b ON b.k = a.k + 0.5e0) q", "halos", "curve")
def n01(spark, d):
    """A function tabulated in equal steps of the logarithm; below the table it is 1."""
    h = halos(spark, d).select("id", "m", F.log2("m").alias("at"))
    out = C.lookup(h, curve(spark), "at", "k", "f")
    return out.select("id", rounded(F.when(F.col("m") < 2, F.lit(1.0)).otherwise(F.col("f"))).alias("f"))


@query("J11_nearest_step", "SELECT z, min_by(a, (abs(z - a), a)) AS a FROM (SELECT DISTINCT CAST(n_nationkey AS DOUBLE)/8e0 AS z FROM nation) r, (SELECT CAST(r_regionkey AS DOUBLE)/2e0 AS a FROM region) s GROUP BY z")
def j11(spark, d):
    wanted = spark.read.parquet(f"{d}/nation.parquet").select((F.col("n_nationkey").cast("double") / 8.0).alias("z")).distinct()
    steps = spark.read.parquet(f"{d}/region.parquet").select((F.col("r_regionkey").cast("double") / 2.0).alias("a"))
    return C.nearest(wanted, steps, "z", "a")


@query("H17_concentration_correction", f"SELECT id, {tidy('conc * (1 + xoff) / exp((xoff/1.5e0) * (xoff/1.5e0))')} AS conc FROM halos", "halos")
def h17(spark, d):
    return halos(spark, d).select("id", rounded(C.corrected_concentration(F.col("conc"), F.col("xoff"))).alias("conc"))


AT = "(0.3e0 / (0.3e0 + 0.7e0 * s*s*s))"
VIR = f"(178e0 + 82e0*({AT}-1) - 39e0*({AT}-1)*({AT}-1)) / {AT}"


@query("H02_overdensity", f"SELECT s AS a, {tidy(f'200e0/{AT}')} AS crit200, {tidy(VIR)} AS virial, {tidy(f'{VIR}*(200e0/178e0)')} AS abacus FROM (SELECT DISTINCT CAST(1 + n_nationkey AS DOUBLE)/25e0 AS s FROM nation) q")
def h02(spark, d):
    steps = spark.read.parquet(f"{d}/nation.parquet").select(((F.col("n_nationkey") + 1).cast("double") / 25.0).alias("a")).distinct()
    return steps.select("a", *[rounded(C.overdensity(0.3, F.col("a"), kind)).alias(name) for kind, name in ((0, "crit200"), (1, "virial"), (3, "abacus"))])


@query("W10_log_spacing", f"SELECT k, {tidy('step')} AS step FROM (SELECT k, step, avg(step) OVER () AS mean FROM (SELECT k, ln(lead(k) OVER (ORDER BY k)) - ln(k) AS step FROM (SELECT k + 1 AS k FROM curve) c) a WHERE step IS NOT NULL) b WHERE abs(step/mean - 1) > 0.02e0", "curve")
def w10(spark, d):
    return C.check_spacing(curve(spark).select((F.col("k") + 1).alias("k"))).select("k", rounded(F.col("step")).alias("step"))


# ---- ensembles

def spectra(spark, d):
    return view(spark, d, "pk_realizations")


@query("M01_ensemble_mean", f"SELECT bin, {whole('min_by(n, realization)')} AS n, {tidy('avg(pk)', 5)} AS mean, {tidy('sqrt(greatest(avg(pk*pk) - avg(pk)*avg(pk), 1e-20))', 4)} AS rms FROM pk_realizations GROUP BY bin", "pk_realizations")
def m01(spark, d):
    return C.ensemble_mean(spectra(spark, d), "bin").select("bin", "n", rounded(F.col("mean"), 5).alias("mean"), rounded(F.col("rms"), 4).alias("rms"))


BI = "SELECT realization, bin % 4 AS k1, (bin // 4) % 4 AS k2, bin // 16 AS k3, pk AS b, n FROM pk_realizations"


@query("M02_bispectrum_mean", f"SELECT k1, k2, k3, {whole('min_by(n, realization)')} AS n, {tidy('avg(b)', 5)} AS mean, {tidy('sqrt(greatest(avg(b*b) - avg(b)*avg(b), 1e-20))', 4)} AS rms FROM ({BI}) q GROUP BY k1, k2, k3", "pk_realizations")
def m02(spark, d):
    b = F.col("bin")
    triples = spectra(spark, d).select("realization", (b % 4).alias("k1"), F.floor(b / 4).cast("long").alias("q"), F.floor(b / 16).cast("long").alias("k3"), F.col("pk").alias("b"), "n").withColumn("k2", F.col("q") % 4)
    return C.ensemble_mean(triples, "k1", "k2", "k3", value="b").select("k1", "k2", "k3", "n", rounded(F.col("mean"), 5).alias("mean"), rounded(F.col("rms"), 4).alias("rms"))


cte("covariances", "SELECT i.bin AS bin_i, j.bin AS bin_j, avg(i.pk*j.pk) AS pp FROM pk_realizations i JOIN pk_realizations j ON i.realization = j.realization GROUP BY 1, 2", "pk_realizations")
cte("bin_means", "SELECT bin, avg(pk) AS m FROM pk_realizations GROUP BY bin", "pk_realizations")
cte("cov", "SELECT c.bin_i, c.bin_j, pp - a.m*b.m AS cov, a.m AS m_i, b.m AS m_j FROM covariances c JOIN bin_means a ON a.bin = c.bin_i JOIN bin_means b ON b.bin = c.bin_j", "covariances", "bin_means")
cte("corr", "SELECT c.bin_i, c.bin_j, c.cov / (sqrt(a.cov) * sqrt(b.cov)) AS r FROM cov c JOIN cov a ON a.bin_i = c.bin_i AND a.bin_j = c.bin_i JOIN cov b ON b.bin_i = c.bin_j AND b.bin_j = c.bin_j", "cov")


@query("J12_realization_products", f"SELECT bin_i, bin_j, {tidy('pp', 3)} AS pp FROM covariances", "covariances")
def j12(spark, d):
    c = C.covariance(spectra(spark, d))
    return c.select("bin_i", "bin_j", rounded(F.col("cov") + F.col("m_i") * F.col("m_j"), 3).alias("pp"))


@query("M03_covariance", f"SELECT bin_i, bin_j, {tidy('cov', 3)} AS cov FROM cov", "cov")
def m03(spark, d):
    return C.covariance(spectra(spark, d)).select("bin_i", "bin_j", rounded(F.col("cov"), 3).alias("cov"))


@query("M04_correlation_matrix", f"SELECT bin_i, bin_j, {tidy('r')} AS r FROM corr", "corr")
def m04(spark, d):
    return C.correlation_matrix(C.covariance(spectra(spark, d))).select("bin_i", "bin_j", rounded(F.col("r")).alias("r"))


@query("W08_smoothed_diagonals", f"SELECT bin_i, bin_j, {tidy('CASE WHEN abs(bin_i - bin_j) > 4 AND c = 5 THEN s ELSE r END')} AS smooth FROM (SELECT *, avg(r) OVER w AS s, count(*) OVER w AS c FROM corr WINDOW w AS (PARTITION BY bin_i - bin_j ORDER BY bin_i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) q", "corr")
def w08(spark, d):
    return C.smooth_diagonals(C.correlation_matrix(C.covariance(spectra(spark, d))), 2).select("bin_i", "bin_j", rounded(F.col("smooth")).alias("smooth"))


@query("U01_union_of_parts", "SELECT realization, bin, pk, n FROM pk_realizations", "pk_realizations")
def u01(spark, d):
    """The realizations, read as parts and put together by name."""
    s = spectra(spark, d)
    return s.where("realization < 8").unionByName(s.where("realization >= 8").select("n", "pk", "bin", "realization"))


LEVELS = "SELECT DISTINCT CAST(realization % 4 AS BIGINT) AS level, bin, (bin + 1) * CAST(1 << CAST(realization % 4 AS INTEGER) AS DOUBLE) / 16e0 AS k FROM pk_realizations"


@query("U03_stitched_spectrum", f"SELECT level, bin, k FROM ({LEVELS}) q WHERE (level = 0 AND k <= 1e0) OR (level = 1 AND k > 1e0 AND k <= 2.5e0) OR (level = 2 AND k > 2.5e0 AND k <= 6.25e0) OR (level = 3 AND k > 6.25e0 AND k <= 15.625e0)", "pk_realizations")
def u03(spark, d):
    level = (F.col("realization") % 4).cast("long")
    s = spectra(spark, d).select(level.alias("level"), "bin", ((F.col("bin") + 1) * F.pow(F.lit(2.0), level) / 16.0).alias("k")).distinct()
    return C.stitch(s, 2.5, first_bins=15)


# ---- logs

def log(spark, d):
    return view(spark, d, "log")


cte("numbered", "SELECT line, iter, residual, CAST(sum(s) OVER (ORDER BY line) AS BIGINT) AS step FROM (SELECT *, CASE WHEN coalesce(iter <= lag(iter) OVER (ORDER BY line), true) THEN 1 ELSE 0 END AS s FROM log) q", "log")


@query("W09_numbered_steps", "SELECT line, iter, residual, step FROM numbered", "numbered")
def w09(spark, d):
    return C.number_sessions(log(spark, d))


@query(
    "J13_aligned_logs",
    "SELECT coalesce(a.step, b.step) AS step, coalesce(a.iter, b.iter) AS iter, a.residual AS ref, b.residual AS other, CASE WHEN a.step IS NULL THEN 'only_other' WHEN b.step IS NULL THEN 'only_ref' ELSE 'both' END AS side, abs(a.residual - b.residual) AS diff FROM (SELECT * FROM numbered WHERE line % 11 <> 0) a FULL JOIN (SELECT step, iter, residual * 2e0 AS residual FROM numbered WHERE line % 13 <> 0) b ON a.step = b.step AND a.iter = b.iter",
    "numbered",
)
def j13(spark, d):
    own = C.number_sessions(log(spark, d))
    return C.align(own.where("line % 11 <> 0"), own.where("line % 13 <> 0").withColumn("residual", F.col("residual") * 2.0), "step", "iter")


@query("A12_largest_difference", "SELECT max(abs(a.residual - b.residual)) AS diff, CAST(max_by(a.line, (abs(a.residual - b.residual), a.line)) AS BIGINT) AS line FROM log a JOIN log b ON b.line = a.line + 7", "log")
def a12(spark, d):
    a, b = log(spark, d).alias("a"), log(spark, d).alias("b")
    diff = F.abs(F.col("a.residual") - F.col("b.residual"))
    return a.join(b, F.col("b.line") == F.col("a.line") + 7).agg(F.max(diff).alias("diff"), F.max(F.struct(diff.alias("d"), F.col("a.line").alias("line")))["line"].alias("line"))


@query("A11_median_of_medians", f"SELECT threads, {tidy('median(m)', 5)} AS median FROM (SELECT line % 4 AS threads, line % 12 AS run, median(residual) AS m FROM log WHERE iter > 0 GROUP BY 1, 2) q GROUP BY threads", "log")
def a11(spark, d):
    runs = log(spark, d).where("iter > 0").select((F.col("line") % 4).alias("threads"), (F.col("line") % 12).alias("run"), "residual")
    return C.median_of_medians(runs, "residual", ["threads", "run"], ["threads"]).select("threads", rounded(F.col("median"), 5).alias("median"))


# ---- profiles of halos: shells of particles around heavy ones are in halo_queries; here windows on a plain profile

cte("profile", f"SELECT o_custkey % 50 AS halo, CAST(o_orderkey % 12 AS BIGINT) AS bin, sum(CAST(1 + o_orderkey % 9 AS DOUBLE)) AS mass FROM orders GROUP BY 1, 2")


def profile(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.groupBy((F.col("o_custkey") % 50).alias("halo"), (F.col("o_orderkey") % 12).alias("bin")).agg(F.sum((1 + F.col("o_orderkey") % 9).cast("double")).alias("mass"))


@query("W02_mass_profile", "SELECT halo, bin, mass, sum(mass) OVER (PARTITION BY halo ORDER BY bin) AS inside FROM profile", "profile")
def w02(spark, d):
    return profile(spark, d).withColumn("inside", F.sum("mass").over(Window.partitionBy("halo").orderBy("bin")))


@query("W06_shell_differences", "SELECT halo, bin, inside - coalesce(lag(inside) OVER (PARTITION BY halo ORDER BY bin), 0e0) AS mass FROM (SELECT halo, bin, sum(mass) OVER (PARTITION BY halo ORDER BY bin) AS inside FROM profile) q", "profile")
def w06(spark, d):
    w = Window.partitionBy("halo").orderBy("bin")
    inside = profile(spark, d).withColumn("inside", F.sum("mass").over(w))
    return inside.select("halo", "bin", (F.col("inside") - F.coalesce(F.lag("inside").over(w), F.lit(0.0))).alias("mass"))
