"""Statistics of catalogs and ensembles: bins, cumulative functions, quantiles, lookups, means and covariances.

Window functions run over bins, of which there are few, never over the rows of a catalog in one partition; ranks over
whole catalogs are taken by bin.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshlark.functions.storage import cut, few


def linear_bin(value: Column, width: float) -> Column:
    return F.floor(value / width).cast("long")


def binned_mean(df: DataFrame, key: Column, *values: str) -> DataFrame:
    """(bin, n, mean and rms of each value)."""
    rms = lambda v: F.sqrt(F.greatest(F.avg(F.col(v) * F.col(v)) - F.avg(v) * F.avg(v), F.lit(0.0)))
    return df.groupBy(key.alias("bin")).agg(F.count(F.lit(1)).alias("n"), *[F.avg(v).alias(f"{v}_mean") for v in values], *[rms(v).alias(f"{v}_rms") for v in values])


def dense_bins(counts: DataFrame, column: str = "bin") -> DataFrame:
    """All bins between the first and the last that has rows; a missing one counts 0."""
    ends = counts.agg(F.min(column).alias("a"), F.max(column).alias("z")).where("a IS NOT NULL")
    every = ends.select(F.explode(F.sequence("a", "z")).alias(column))
    others = [c for c in counts.columns if c != column]
    return every.join(counts, column, "left").select(column, *[F.coalesce(c, F.lit(0)).alias(c) for c in others])


def cumulative_above(counts: DataFrame, *by: str) -> DataFrame:
    """counts (by, bin, n) with above: the number in this bin and higher ones."""
    w = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return counts.withColumn("above", F.sum("n").over(w))


def mass_function(halos: DataFrame, width: float, volume: float) -> DataFrame:
    """(bin, n, mass_mean, above, n_above, dn_dbin): counts by log10 of mass, cumulative and per volume."""
    bins = halos.groupBy(F.floor(F.log10("m") / width).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("m").alias("mass_mean"))
    out = cumulative_above(bins)
    return out.withColumns({"n_above": F.col("above") / volume, "dn_dbin": F.col("n") / (volume * width)})


def velocity_function(halos: DataFrame, width: float, volume: float) -> DataFrame:
    """(bin, n, speed_mean, above, n_above) by speed against the mean motion."""
    v2 = F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy") + F.col("vz") * F.col("vz")
    speed = F.sqrt(v2)
    bins = halos.groupBy(linear_bin(speed, width).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(speed).alias("speed_mean"))
    return cumulative_above(bins).withColumn("n_above", F.col("above") / volume)


def component_distribution(df: DataFrame, width: float, columns: tuple[str, ...] = ("vx", "vy", "vz")) -> DataFrame:
    """(axis, bin, n): each component's values, unpivoted."""
    parts = F.array(*[F.struct(F.lit(c).alias("axis"), F.col(c).alias("v")) for c in columns])
    return df.select(F.inline(parts)).groupBy("axis", linear_bin(F.col("v"), width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def violations(df: DataFrame, limits: dict[str, tuple[float, float]]) -> DataFrame:
    """(id, column, value) of values outside their limits."""
    parts = F.array(*[F.when((F.col(c) < a) | (F.col(c) > b) | F.col(c).isNull(), F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"))) for c, (a, b) in limits.items()])
    return df.select("id", F.inline(F.array_compact(parts)))


def ranked(df: DataFrame, order: str, *by: str) -> DataFrame:
    """df with rank within groups; ties by id."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(order, "id")))


def global_rank(df: DataFrame, order: str, parts: int = 64) -> DataFrame:
    """df with its rank by a column over all rows: ranges of values are ranked apart, then moved by what lies below."""
    cuts = df.stat.approxQuantile(order, [i / parts for i in range(1, parts)], 0.001) if parts > 1 else []
    place = reduce(lambda c, x: c + F.when(F.col(order) > x, 1).otherwise(0), sorted(set(cuts)), F.lit(0))
    own = df.withColumn("__p", place)
    below = own.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    below = below.withColumn("__below", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # parts rows
    local = F.row_number().over(Window.partitionBy("__p").orderBy(order, "id"))
    return own.withColumn("__r", local).join(F.broadcast(below), "__p").withColumn("rank", (F.col("__r") + F.col("__below")).cast("long")).drop("__p", "__r", "__n", "__below")


QUANTILES = (0.10, 0.32, 0.50, 0.68, 0.90)


def bin_quantiles(df: DataFrame, value: str, *by: str, least: int = 10, quantiles=QUANTILES, parts: int = 1024) -> DataFrame:
    """(by, n, q10, ...): the value at place int(q * n) + 1 in order, for groups of more than `least` rows.

    A group's range is cut into parts whose rows are counted; only parts that hold one of the places are looked into, by
    value and count.  So no task sorts a group, however large it is or however often a value occurs.
    """
    own = df.select(*by, F.col(value).alias("__v")).where("__v IS NOT NULL")
    ends = few(own.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("__v").alias("__a"), F.max("__v").alias("__z")).where(F.col("n") > least))
    share = (F.col("__v") - F.col("__a")) / F.nullif(F.col("__z") - F.col("__a"), F.lit(0.0))
    part = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * parts), F.lit(parts - 1)).cast("int")
    placed = own.join(ends, list(by)).select(*by, "n", part.alias("__p"), "__v")
    up_to = Window.partitionBy(*by).orderBy("__p")  # parts of a group
    counts = placed.groupBy(*by, "n", "__p").agg(F.count(F.lit(1)).alias("__c")).withColumn("__to", F.sum("__c").over(up_to))
    wanted = F.explode(F.array(*[F.struct(F.lit(round(100 * q)).alias("q"), (F.floor(F.lit(q) * F.col("n")) + 1).alias("at")) for q in quantiles]))
    hit = counts.select("*", wanted.alias("__w")).where("__w.at <= __to AND __w.at > __to - __c")
    hit = few(hit.select(*by, "__p", F.col("__w.q").alias("__q"), (F.col("__w.at") - (F.col("__to") - F.col("__c"))).alias("__at")))
    values = placed.join(hit.select(*by, "__p").distinct(), [*by, "__p"], "left_semi").groupBy(*by, "n", "__p", "__v").agg(F.count(F.lit(1)).alias("__c"))
    values = values.withColumn("__to", F.sum("__c").over(Window.partitionBy(*by, "__p").orderBy("__v")))
    found = values.join(hit, [*by, "__p"]).where("__at <= __to AND __at > __to - __c")
    at = lambda q: F.max(F.when(F.col("__q") == round(100 * q), F.col("__v")))
    return found.groupBy(*by, "n").agg(*[at(q).alias(f"q{round(100 * q)}") for q in quantiles])


def adaptive_edges(counts: list[tuple[int, int]], least: int, growth: float) -> list[tuple[int, int]]:
    """Ranges of fine bins (first, last), each widened by growth until it has `least` rows; counts are (bin, n) in order."""
    out: list[tuple[int, int]] = []
    if not counts:
        return out
    have = dict(counts)
    at, last = counts[0][0], counts[-1][0]
    width = 1.0
    while at <= last:
        end = min(at + max(round(width), 1) - 1, last)
        n = sum(have.get(b, 0) for b in range(at, end + 1))
        while n < least and end < last:
            width *= growth
            end = min(at + round(width) - 1, last)
            n = sum(have.get(b, 0) for b in range(at, end + 1))
        out.append((at, end))
        at = end + 1
    return out


#: Rows of a tabulated function, or bins, that are held as one sorted array.
TABLE_ROWS = 1 << 17


def bracket(x: Column, places: Column, n: int) -> Column:
    """The number of entries of a sorted array of n that are at most x, by bisection."""
    start = F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.shiftright(s["lo"] + s["hi"], 1)
        below = F.get(places, mid) <= x
        more = s["lo"] < s["hi"]
        return F.struct(F.when(more & below, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(more & ~below, mid).otherwise(s["hi"]).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(max(n, 1).bit_length())), start, halve)["lo"]


def adaptive_quantiles(df: DataFrame, fine: Column, value: str, least: int = 600, growth: float = 1.5) -> DataFrame:
    """(low, high, n, quantiles of value) over bins of a fine binning, joined until each has `least` rows.

    Bins follow from those before them, so the fine bins' counts (TABLE_ROWS at most) are gone through on the driver.
    """
    own = df.withColumn("__fine", fine.cast("long")).where("__fine IS NOT NULL")
    counts = own.groupBy("__fine").count()
    rows = counts.limit(TABLE_ROWS + 1).collect()
    if len(rows) > TABLE_ROWS:
        raise ValueError(f"over {TABLE_ROWS} fine bins: take wider ones")
    edges = adaptive_edges(sorted((r[0], r[1]) for r in rows), least, growth)
    lows = F.array(*[F.lit(a) for a, _ in edges]) if edges else F.array().cast("array<long>")
    highs = F.array(*[F.lit(z) for _, z in edges]) if edges else F.array().cast("array<long>")
    at = bracket(F.col("__fine"), lows, len(edges)) - 1
    placed = own.select(value, at.alias("__at")).select(value, F.get(lows, F.col("__at")).alias("low"), F.get(highs, F.col("__at")).alias("high"))
    return bin_quantiles(placed, value, "low", "high")


def sorted_table(table: DataFrame, *columns: str) -> tuple[DataFrame, int]:
    """One row with an array of each column, in order of the first, and their length; TABLE_ROWS at most."""
    n = table.limit(TABLE_ROWS + 1).count()
    if n > TABLE_ROWS:
        raise ValueError(f"a table of over {TABLE_ROWS} rows")
    rows = table.agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("__t"))
    return rows.select(*[F.col("__t").getField(c).alias(f"__{c}s") for c in columns]), n


def lookup(df: DataFrame, table: DataFrame, at: str, key: str, value: str) -> DataFrame:
    """df with value interpolated linearly between the two rows of a sorted table around df's column at.

    table: a tabulated function of TABLE_ROWS rows at most, broadcast as one row of arrays in which each row of df finds
    its place by bisection.  Outside the table's range the result is null.
    """
    arrays, n = sorted_table(table.select(F.col(key).alias("k"), F.col(value).alias("f")), "k", "f")
    held = df.crossJoin(F.broadcast(arrays)).withColumn("__i", F.least(bracket(F.col(at), F.col("__ks"), n), F.lit(n - 1)) - 1)  # one row
    of = lambda c, more: F.when(F.col("__i") >= 0, F.get(c, F.col("__i") + more))
    a, b, fa, fb = of("__ks", 0), of("__ks", 1), of("__fs", 0), of("__fs", 1)
    inside = (F.col(at) >= a) & (F.col(at) <= b)
    return held.withColumn(value, F.when(inside, fa + (fb - fa) * ((F.col(at) - a) / (b - a)))).drop("__ks", "__fs", "__i")


def nearest(requests: DataFrame, steps: DataFrame, request: str, step: str) -> DataFrame:
    """Each distinct request with the step nearest to it (ties: the smaller); steps: TABLE_ROWS at most, broadcast as one row."""
    arrays, n = sorted_table(steps.select(F.col(step).alias("s")).distinct(), "s")
    held = requests.select(request).distinct().crossJoin(F.broadcast(arrays)).withColumn("__i", bracket(F.col(request), F.col("__ss"), n))  # one row
    low, high = F.when(F.col("__i") > 0, F.get("__ss", F.col("__i") - 1)), F.get("__ss", F.col("__i"))
    near = F.when(low.isNull() | (high - F.col(request) < F.col(request) - low), high).otherwise(low)
    return held.select(request, near.alias(step))


def corrected_concentration(conc: Column, d: Column) -> Column:
    """C (1 + d) / exp((d / 1.5)**2): a correction for resolution."""
    return conc * (1 + d) / F.exp((d / 1.5) * (d / 1.5))


def overdensity(omega_m: Column | float, a: Column | float, kind: int) -> Column:
    """Overdensity against the mean of a bound object: 0: 200 critical, 1: virial, 2: 200 mean, 3: virial * 200 / 178."""
    om, a = (F.lit(float(x)) if isinstance(x, (int, float)) else x for x in (omega_m, a))
    at = om / (om + (1 - om) * a * a * a)  # matter's share at scale factor a
    x = at - 1
    virial = (178.0 + 82.0 * x - 39.0 * x * x) / at
    return {0: 200.0 / at, 1: virial, 2: F.lit(200.0) + 0 * at, 3: virial * (200.0 / 178.0)}[kind]


# ---- ensembles --------------------------------------------------------------------------------------------------------


def ensemble_mean(spectra: DataFrame, *by: str, value: str = "pk") -> DataFrame:
    """(by, n, mean, rms) over realizations; n is that of the first realization."""
    square = F.avg(F.col(value) * F.col(value)) - F.avg(value) * F.avg(value)
    return spectra.groupBy(*by).agg(F.min_by("n", "realization").alias("n"), F.avg(value).alias("mean"), F.sqrt(F.greatest(square, F.lit(1e-20))).alias("rms"))


def covariance(spectra: DataFrame, key: str = "bin", value: str = "pk") -> DataFrame:
    """(bin_i, bin_j, cov): mean of products less product of means over realizations that have both bins."""
    a, b = (spectra.select("realization", F.col(key).alias(f"bin_{x}"), F.col(value).alias(f"p_{x}")) for x in "ij")
    mean = spectra.groupBy(key).agg(F.avg(value).alias("m"))
    out = a.join(b, "realization").groupBy("bin_i", "bin_j").agg(F.avg(F.col("p_i") * F.col("p_j")).alias("pp"))
    for x in "ij":
        out = out.join(F.broadcast(mean.select(F.col(key).alias(f"bin_{x}"), F.col("m").alias(f"m_{x}"))), f"bin_{x}")  # a row a bin
    return out.select("bin_i", "bin_j", (F.col("pp") - F.col("m_i") * F.col("m_j")).alias("cov"), "m_i", "m_j")


def correlation_matrix(cov: DataFrame) -> DataFrame:
    """cov normalised by the variances of its bins: 1 on the diagonal."""
    own = cov.where("bin_i = bin_j").select(F.col("bin_i").alias("b"), F.sqrt("cov").alias("s"))
    out = cov
    for x in "ij":
        out = out.join(F.broadcast(own.select(F.col("b").alias(f"bin_{x}"), F.col("s").alias(f"s_{x}"))), f"bin_{x}")
    return out.withColumn("r", F.when((F.col("s_i") > 0) & (F.col("s_j") > 0), F.col("cov") / (F.col("s_i") * F.col("s_j")))).drop("s_i", "s_j")


def smooth_diagonals(cov: DataFrame, half: int, keep: int = 4, value: str = "r") -> DataFrame:
    """value averaged over 2 half + 1 neighbours along the diagonal; within `keep` of the main diagonal it stays."""
    w = Window.partitionBy(F.col("bin_i") - F.col("bin_j")).orderBy("bin_i").rowsBetween(-half, half)
    apart = F.abs(F.col("bin_i") - F.col("bin_j")) > keep
    return cov.withColumn("smooth", F.when(apart & (F.count(F.lit(1)).over(w) == 2 * half + 1), F.avg(value).over(w)).otherwise(F.col(value)))


def number_sessions(log: DataFrame, order: str = "line", counter: str = "iter", by: str | None = None) -> DataFrame:
    """log with step: it grows by one whenever the counter doesn't.  Per log (by), or over one log in ranges of lines."""
    if by is not None:
        w = Window.partitionBy(by).orderBy(order)
        fresh = F.when(F.coalesce(F.col(counter) <= F.lag(counter).over(w), F.lit(True)), 1).otherwise(0)
        return log.withColumn("__new", fresh).withColumn("step", F.sum("__new").over(w).cast("long")).drop("__new")
    # one log: ranges of lines are numbered apart, each with the last row of the range before it
    size = 1 << 16
    own = log.withColumn("__range", F.floor(F.col(order) / size))
    ends = own.groupBy("__range").agg(F.max_by(counter, order).alias("__last"), F.count(F.lit(1)).alias("__c"))
    ends = ends.withColumn("__before", F.lag("__last").over(Window.orderBy("__range")))  # a row a range
    w = Window.partitionBy("__range").orderBy(order)
    own = own.join(F.broadcast(ends.select("__range", "__before")), "__range")
    fresh = F.when(F.coalesce(F.col(counter) <= F.coalesce(F.lag(counter).over(w), F.col("__before")), F.lit(True)), 1).otherwise(0)
    own = own.withColumn("__new", fresh)
    starts = own.groupBy("__range").agg(F.sum("__new").alias("__s"))
    starts = starts.withColumn("__base", F.coalesce(F.sum("__s").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = own.join(F.broadcast(starts.select("__range", "__base")), "__range")
    return own.withColumn("step", (F.sum("__new").over(w) + F.col("__base")).cast("long")).drop("__range", "__before", "__new", "__base")


def align(ref: DataFrame, other: DataFrame, *keys: str, value: str = "residual") -> DataFrame:
    """Both logs by key, with diff, or the side that alone has the key."""
    a, b = (x.select(*keys, F.col(value).alias(n), F.lit(True).alias(f"has_{n}")) for x, n in ((ref, "ref"), (other, "other")))
    out = a.join(b, list(keys), "full_outer")
    side = F.when(F.col("has_ref").isNull(), "only_other").when(F.col("has_other").isNull(), "only_ref").otherwise("both")
    return out.select(*keys, "ref", "other", side.alias("side"), F.abs(F.col("ref") - F.col("other")).alias("diff"))


def median_of_medians(df: DataFrame, value: str, inner: list[str], outer: list[str]) -> DataFrame:
    return df.groupBy(*inner).agg(F.percentile(value, F.lit(0.5)).alias("median")).groupBy(*outer).agg(F.percentile("median", F.lit(0.5)).alias("median"))


def check_spacing(spark_table: DataFrame, key: str = "k", tolerance: float = 0.02) -> DataFrame:
    """Rows whose log spacing to the next deviates from the table's mean spacing by more than the tolerance."""
    w = Window.orderBy(key)  # a tabulated function is short
    steps = spark_table.withColumn("step", F.log(F.lead(key).over(w)) - F.log(key)).where("step IS NOT NULL")
    mean = steps.agg(F.avg("step").alias("mean"))
    return steps.crossJoin(F.broadcast(mean)).where(F.abs(F.col("step") / F.col("mean") - 1) > tolerance).select(key, "step")


def stitch(spectra: DataFrame, ratio: float = 2.5, first_bins: int | None = None) -> DataFrame:
    """One spectrum from those of folded meshes (level, bin, k, ...): each level takes over where the one before ends.

    The first level gives its lowest bins; a further one the k over that end, up to ratio times it.
    """
    spectra = cut(spectra)  # a row a level and bin, read for each level
    levels = sorted(r[0] for r in spectra.select("level").distinct().collect())  # a handful
    out, end = None, None
    for level in levels:
        own = spectra.where(F.col("level") == level)
        part = own.where(F.col("bin") <= first_bins) if end is None else own.where((F.col("k") > end) & (F.col("k") <= ratio * end))
        top = part.agg(F.max("k")).first()[0]
        end = top if top is not None else end
        out = part if out is None else out.unionByName(part)
    return out

