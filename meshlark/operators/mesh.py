"""Meshes in long form (i, j, k, val), 1-based and periodic, and their exchange with particles.

A particle touches the eight nodes around it.  To deposit, one row becomes eight, which are summed by node: a partial
aggregate before a single shuffle.  To gather, the mesh is packed into blocks with one more layer of nodes, and a particle
meets its block alone and reads eight values: blocks are broadcast while the mesh is small, else particles move once.
Nothing depends on the order of rows.  Meshes are dense: range(n**3) gives the nodes that no particle touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AXES = ("x", "y", "z")
CELL = ("i", "j", "k")


def wrap(c: Column, n: int) -> Column:
    """One period back into [1, n + 1)."""
    return F.when(c >= n + 1, c - n).when(c < 1, c + n).otherwise(c)


def wrap_node(c: Column, n: int) -> Column:
    return F.pmod(c - 1, F.lit(n)) + 1


def rescale(points: DataFrame, n_old: int, n_new: int) -> DataFrame:
    """Coordinates of a mesh of n_old cells on one of n_new."""
    return points.withColumns({a: wrap((F.col(a) - 1) * (n_new / n_old) + 1, n_new) for a in AXES})


def to_physical(points: DataFrame, box: float, n: int, a: float) -> DataFrame:
    """Grid coordinates and velocities to box units and km/s."""
    out = points.withColumns({c: (F.col(c) - 1) * (box / n) for c in AXES})
    return out.withColumns({f"v{c}": F.col(f"v{c}") * (100.0 * (box / n) / a) for c in AXES})


def to_grid(points: DataFrame, box: float, n: int, a: float) -> DataFrame:
    out = points.withColumns({c: wrap(F.col(c) / (box / n) + 1, n) for c in AXES})
    return out.withColumns({f"v{c}": F.col(f"v{c}") / (100.0 * (box / n) / a) for c in AXES})


def fold_axis(c: Column, n: int, times: Column) -> Column:
    """A coordinate folded into 1/times of the box and stretched back to n cells."""
    part = F.lit(float(n)) / times
    return (c - 1 - F.floor((c - 1) / part) * part) * times + 1


def fold(points: DataFrame, n: int, level: int) -> DataFrame:
    """Coordinates folded into 1/2**level of the box and stretched back to n cells."""
    return points.withColumns({a: fold_axis(F.col(a), n, F.lit(float(1 << level))) for a in AXES})


def redshift_space(points: DataFrame, axis: int, factor: float, n: int) -> DataFrame:
    """Positions shifted along an axis by velocity, permuted so that the line of sight is z."""
    los = AXES[axis - 1]
    moved = points.withColumn(los, wrap(F.col(los) + F.col(f"v{los}") * factor, n))
    return moved.withColumns({"x": F.col("z"), "z": F.col("x")}) if axis == 1 else moved.withColumns({"y": F.col("z"), "z": F.col("y")}) if axis == 2 else moved


EIGHT = [(p, q, r) for p in (0, 1) for q in (0, 1) for r in (0, 1)]


def corners(points: DataFrame, n: int, levels: tuple[int, ...] = ()) -> DataFrame:
    """Each row of points eight times, with the node (i, j, k) and its trilinear weight w.

    With levels, eight times for each, with coordinates folded that often and the level.  Literal offsets are exploded,
    nodes and weights computed after, so that floors and fractions are evaluated once a row.
    """
    sides = F.array(*[F.struct(*[F.lit(x).alias(f"__o{a}") for x, a in zip(o, AXES, strict=True)]) for o in EIGHT])
    held = points
    if levels:
        held = held.select("*", F.explode(F.array(*[F.lit(x) for x in levels])).alias("level"))
    at = {a: fold_axis(F.col(a), n, F.pow(F.lit(2.0), F.col("level"))) if levels else F.col(a) for a in AXES}
    held = held.withColumns({f"__at{a}": at[a] for a in AXES})
    held = held.withColumns({f"__lo{a}": F.floor(f"__at{a}").cast("int") for a in AXES})
    held = held.withColumns({f"__fr{a}": F.col(f"__at{a}") - F.col(f"__lo{a}") for a in AXES})
    out = held.select("*", F.inline(sides))
    node = {c: wrap_node(F.col(f"__lo{a}") + F.col(f"__o{a}"), n).cast("int") for a, c in zip(AXES, CELL, strict=True)}
    share = {a: F.when(F.col(f"__o{a}") == 0, 1.0 - F.col(f"__fr{a}")).otherwise(F.col(f"__fr{a}")) for a in AXES}
    own = [*points.columns, *(["level"] if levels else [])]
    return out.select(*own, *[v.alias(c) for c, v in node.items()], (share["x"] * share["y"] * share["z"]).alias("w"))


def nodes(spark: SparkSession, n: int) -> DataFrame:
    """All nodes of a mesh."""
    c = F.col("id")
    one = lambda x: (F.pmod(x, F.lit(n)) + 1).cast("int")
    return spark.range(n**3).select(one(F.floor(c / (n * n))).alias("i"), one(F.floor(c / n)).alias("j"), one(c).alias("k"))


def dense(sparse: DataFrame, n: int, value: str = "w", default: float = 0.0) -> DataFrame:
    return nodes(sparse.sparkSession, n).join(sparse, list(CELL), "left").withColumn(value, F.coalesce(value, F.lit(default)))


def scale(n: int) -> Column:
    """Cells over the total of all weights; infinite if that is 0, so that the contrast of no points is no number."""
    total = F.col("total")
    return F.when(total == 0, F.lit(float("inf"))).otherwise(F.lit(float(n**3)) / total)


def deposit(points: DataFrame, n: int, weight: str | None = None) -> DataFrame:
    """(i, j, k, val): density contrast of points, or of their weights, by cloud-in-cell."""
    w = F.col("w") if weight is None else F.col("w") * F.col(weight)
    total = points.agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).cast("double").alias("total"))
    sums = corners(points.select(*AXES, *([] if weight is None else [weight])), n).groupBy(*CELL).agg(F.sum(w).alias("w"))
    return dense(sums, n).crossJoin(F.broadcast(total)).select(*CELL, (F.col("w") * scale(n) - 1).alias("val"))  # one row


def deposit_nearest(points: DataFrame, n: int) -> DataFrame:
    """Density contrast with each point in one cell."""
    total = points.agg(F.count(F.lit(1)).cast("double").alias("total"))
    cell = [F.floor(F.col(a)).cast("int").alias(c) for a, c in zip(AXES, CELL, strict=True)]
    sums = points.select(*cell).groupBy(*CELL).agg(F.count(F.lit(1)).cast("double").alias("w"))
    return dense(sums, n).crossJoin(F.broadcast(total)).select(*CELL, (F.col("w") * scale(n) - 1).alias("val"))


#: Nodes of a mesh whose blocks are broadcast: at 8 bytes each and value, 17 MB a value.
BROADCAST_NODES = 128**3
#: Most cells of a block along an axis.
BLOCK = 32


def block_side(n: int, most: int = BLOCK) -> int:
    """The largest divisor of n up to most: blocks of as many cells along an axis tile the mesh."""
    return max(b for b in range(1, min(n, most) + 1) if n % b == 0)


def packed(mesh: DataFrame, n: int, values: tuple[str, ...], side: int) -> DataFrame:
    """(bi, bj, bk, and by value an array): blocks of side**3 cells with the layer of nodes behind them, in order.

    A node is in its own block and, if it is a block's first along an axis, in the one ahead, too.  Nodes that a sparse
    mesh lacks are 0.
    """
    held = mesh.select(*CELL, *values)
    for c in CELL:
        own = F.floor((F.col(c) - 1) / side).cast("int")
        at = (F.col(c) - 1 - own * side).cast("int")
        ahead = F.pmod(own - 1, F.lit(n // side)).cast("int")
        both = F.array(F.struct(own.alias(f"b{c}"), at.alias(f"__{c}")), F.struct(ahead.alias(f"b{c}"), F.lit(side).alias(f"__{c}")))
        held = held.select("*", F.inline(F.when(at == 0, both).otherwise(F.slice(both, 1, 1))))
    width = side + 1
    place = (F.col("__i") * width + F.col("__j")) * width + F.col("__k")
    full = width**3
    blocks = held.groupBy("bi", "bj", "bk").agg(F.collect_list(F.struct(place.alias("at"), *values)).alias("all"))
    # a dense block is its nodes in order; of a sparse one the gaps are filled
    filled = F.transform(F.sequence(F.lit(0), F.lit(full - 1)), lambda p: F.struct(p.alias("at"), *[F.lit(0.0).alias(v) for v in values]))
    gaps = F.filter(filled, lambda x: ~F.array_contains(F.transform("all", lambda y: y["at"]), x["at"]))
    every = F.array_sort(F.when(F.size("all") == full, F.col("all")).otherwise(F.concat(F.col("all"), gaps)))
    return blocks.select("bi", "bj", "bk", every.alias("all")).select("bi", "bj", "bk", *[F.col("all").getField(v).alias(f"__{v}") for v in values])


def at_points(points: DataFrame, mesh: DataFrame, n: int, values: dict[str, str]) -> DataFrame:
    """points with the mesh's values at each, trilinear: values maps new columns to those of the mesh."""
    side = block_side(n)
    held = points.withColumns({f"__lo{a}": F.floor(a).cast("int") for a in AXES})
    held = held.withColumns({f"__fr{a}": F.col(a) - F.col(f"__lo{a}") for a in AXES})
    held = held.withColumns({f"b{c}": F.floor((wrap_node(F.col(f"__lo{a}"), n) - 1) / side).cast("int") for a, c in zip(AXES, CELL, strict=True)})
    held = held.withColumns({f"__p{a}": F.pmod(wrap_node(F.col(f"__lo{a}"), n) - 1, F.lit(side)).cast("int") for a in AXES})
    held = held.withColumn("__at", (F.col("__px") * (side + 1) + F.col("__py")) * (side + 1) + F.col("__pz"))
    blocks = packed(mesh, n, tuple(dict.fromkeys(values.values())), side)
    met = held.join(F.broadcast(blocks) if n**3 <= BROADCAST_NODES else blocks, ["bi", "bj", "bk"])
    share = {a: (1.0 - F.col(f"__fr{a}"), F.col(f"__fr{a}")) for a in AXES}
    weights = {o: share["x"][o[0]] * share["y"][o[1]] * share["z"][o[2]] for o in EIGHT}
    step = {o: (o[0] * (side + 1) + o[1]) * (side + 1) + o[2] for o in EIGHT}
    of = lambda v: sum((weights[o] * F.get(f"__{v}", F.col("__at") + step[o]) for o in EIGHT), F.lit(0.0))
    return met.select(*points.columns, *[of(v).alias(name) for name, v in values.items()])


def gather(points: DataFrame, mesh: DataFrame, n: int, value: str = "val", keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """(keys, dens): the mesh's value at each point, trilinear, plus one."""
    return at_points(points.select(*keys, *AXES), mesh, n, {"dens": value}).select(*keys, (F.col("dens") + 1).alias("dens"))


def project(mesh: DataFrame, n: int) -> DataFrame:
    """(plane, a, b, dens): means of val + 1 along z, y and x, as one aggregate over three groupings."""
    planes = F.array(*[F.struct(F.lit(p).alias("plane"), F.col(a).alias("a"), F.col(b).alias("b")) for p, a, b in (("xy", "i", "j"), ("xz", "i", "k"), ("yz", "j", "k"))])
    return mesh.select("val", F.inline(planes)).groupBy("plane", "a", "b").agg((F.sum(F.col("val") + 1) / n).alias("dens"))


def moments(mesh: DataFrame, *by: str) -> DataFrame:
    return mesh.groupBy(*by).agg(F.avg("val").alias("mean"), F.sqrt(F.greatest(F.avg(F.col("val") * F.col("val")) - F.avg("val") * F.avg("val"), F.lit(0.0))).alias("rms"))


def normalise(meshes: DataFrame, by: str = "level") -> DataFrame:
    """Each mesh less its mean."""
    means = meshes.groupBy(by).agg(F.avg("val").alias("mean"))
    return meshes.join(F.broadcast(means), by).withColumn("val", F.col("val") - F.col("mean"))  # a row a level


def log_bin(value: Column, width: float, low: int, high: int) -> Column:
    """Bin of log10, within limits; values that aren't positive fall into the lowest."""
    return F.when(value > 0, F.greatest(F.least(F.floor(F.log10(value) / width), F.lit(high)), F.lit(low))).otherwise(F.lit(low)).cast("long")


def density_distribution(mesh: DataFrame, width: float = 0.05, low: int = -60, high: int = 60, *by: str) -> DataFrame:
    """(bin, n, mean density): cells by log bins of their density."""
    rho = F.col("val") + 1
    return mesh.select(*by, log_bin(rho, width, low, high).alias("bin"), rho.alias("rho")).groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("rho").alias("rho"))


OFFSETS_26 = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) != (0, 0, 0)]
OFFSETS_6 = [(-1, 0, 0), (1, 0, 0), (0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1)]
#: Six faces, and one edge neighbour each way in every plane.
OFFSETS_12 = OFFSETS_6 + [(-1, -1, 0), (1, 1, 0), (-1, 0, -1), (1, 0, 1), (0, -1, -1), (0, 1, 1)]


def shifted(mesh: DataFrame, offsets: list[tuple[int, int, int]], n: int, value: str = "val") -> DataFrame:
    """Each node's value at all nodes that see it at one of the offsets: (i, j, k, a, b, c, near)."""
    to = F.array(*[F.struct(*[F.lit(x).alias(y) for x, y in zip(o, "abc", strict=True)]) for o in offsets])
    moved = mesh.select(*CELL, F.col(value).alias("near"), F.inline(to))
    return moved.withColumns({c: wrap_node(F.col(c) - F.col(o), n).cast("int") for c, o in zip(CELL, "abc", strict=True)})


def peaks(mesh: DataFrame, least: float, n: int, offsets=tuple(OFFSETS_26), strict: bool = False) -> DataFrame:
    """Nodes over a threshold that no neighbour exceeds (or, if strict, equals)."""
    high = mesh.where(F.col("val") > least)
    around = shifted(mesh, list(offsets), n).join(high.select(*CELL), list(CELL), "left_semi").groupBy(*CELL).agg(F.max("near").alias("near"))
    top = (F.col("val") > F.col("near")) if strict else (F.col("val") >= F.col("near"))
    return high.join(around, list(CELL)).where(top).select(*CELL, "val")


def gradient(mesh: DataFrame, n: int) -> DataFrame:
    """(i, j, k, gx, gy, gz): half the central difference."""
    near = shifted(mesh, OFFSETS_6, n)
    part = lambda o: F.sum(F.col("near") * F.col(o)) / 2
    return near.groupBy(*CELL).agg(part("a").alias("gx"), part("b").alias("gy"), part("c").alias("gz"))


def laplacian(mesh: DataFrame, n: int) -> DataFrame:
    """(i, j, k, val): seven-point sum of neighbours less six times the node."""
    near = shifted(mesh, OFFSETS_6, n).groupBy(*CELL).agg(F.sum("near").alias("near"))
    return mesh.join(near, list(CELL)).select(*CELL, (F.col("near") - 6 * F.col("val")).alias("val"))


def restrict(mesh: DataFrame) -> DataFrame:
    """The mesh of half the cells: means of eight."""
    half = [((F.col(c) + 1) / 2).cast("int").alias(c) for c in CELL]
    return mesh.select(*half, "val").groupBy(*CELL).agg(F.avg("val").alias("val"))


def prolong(coarse: DataFrame, n: int) -> DataFrame:
    """The mesh of n cells from one of n / 2: 27, 9, 3 and 1 parts in 64 of the eight nearest parents."""
    # each parent reaches four fine nodes along an axis: two of its own at 3/4, one beyond on either side at 1/4
    reach = [(-1, 0.25), (0, 0.75), (1, 0.75), (2, 0.25)]
    to = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c"), F.lit(u * v * w).alias("w")) for a, u in reach for b, v in reach for c, w in reach])
    moved = coarse.select(*CELL, "val", F.inline(to))
    fine = {c: wrap_node(2 * F.col(c) - 1 + F.col(o), n).cast("int") for c, o in zip(CELL, "abc", strict=True)}
    return moved.withColumns(fine).groupBy(*CELL).agg(F.sum(F.col("w") * F.col("val")).alias("val"))


def hash01(row_id: Column, scale: int = 109) -> Column:
    """A number in [0, 1) by a linear congruence of an id."""
    return F.pmod(F.lit(72421) * scale * row_id + F.lit(1349973), F.lit(15485867)) / F.lit(15485867.0)


def sample(points: DataFrame, fraction: float, key: str = "id") -> DataFrame:
    return points.where(hash01(F.col(key)) < fraction)


def sample_dense(points: DataFrame, threshold: float, fraction: float, key: str = "id") -> DataFrame:
    """Points of dens over a threshold, more likely the denser they are."""
    ratio = F.lit(threshold) / F.col("dens")
    return points.where((F.col("dens") > threshold) & (hash01(F.col(key)) < fraction * F.sqrt(F.abs(1 - ratio)) * ratio))


def galaxies(points: DataFrame, mesh: DataFrame, peak_nodes: DataFrame, n: int, threshold: float, fraction: float) -> DataFrame:
    """The first point beside each peak, with from_peak, and a sample of the other dense points."""
    near = corners(points.select("id", *AXES), n).select("id", *CELL).join(peak_nodes.select(*CELL), list(CELL), "left_semi")
    first = near.groupBy(*CELL).agg(F.min("id").alias("id")).select("id").distinct().withColumn("from_peak", F.lit(True))
    held = at_points(points, mesh, n, {"dens": "val"}).withColumn("dens", F.col("dens") + 1)
    marked = held.join(first, "id", "left")
    ratio = F.lit(threshold) / F.col("dens")
    drawn = (F.col("dens") > threshold) & (hash01(F.col("id")) < fraction * F.sqrt(F.abs(1 - ratio)) * ratio)
    return marked.where(F.col("from_peak").isNotNull() | drawn).withColumn("from_peak", F.col("from_peak").isNotNull())


def bias_cells(mesh: DataFrame, n: int, least: float, amplitude: float, power: float) -> DataFrame:
    """Cells over a density, drawn with probability amplitude * (density - least) ** power by a hash of the cell."""
    cell = (F.col("i") + n * (F.col("j") + n * F.col("k"))).cast("long")
    rho = F.col("val") + 1
    return mesh.where((rho > least) & (hash01(cell) < amplitude * F.pow(rho - least, F.lit(power))))


def multi_mesh(points: DataFrame, n: int, levels: int) -> DataFrame:
    """Density contrasts of points folded 1..levels times, by level, in one pass."""
    total = points.agg(F.count(F.lit(1)).cast("double").alias("total"))
    sums = corners(points.select(*AXES), n, tuple(range(1, levels + 1))).groupBy("level", *CELL).agg(F.sum("w").alias("w"))
    every = nodes(points.sparkSession, n).crossJoin(F.broadcast(points.sparkSession.range(1, levels + 1).select(F.col("id").cast("int").alias("level"))))
    full = every.join(sums, ["level", *CELL], "left").crossJoin(F.broadcast(total))
    return full.select("level", *CELL, (F.coalesce("w", F.lit(0.0)) * scale(n) - 1).alias("val"))


def sub_boxes(points: DataFrame, n: int, parts: int) -> DataFrame:
    """Density contrast of each of parts**3 sub-boxes against its own mean: (sub, i, j, k, val), sub-box in one pass."""
    size = n // parts
    own = points.withColumn("sub", sum((F.floor((F.col(a) - 1) / size).cast("int") * parts**p for p, a in enumerate(AXES)), F.lit(0)))
    sums = corners(own.select("sub", *AXES), n).groupBy("sub", *CELL).agg(F.sum("w").alias("w"))
    counts = own.groupBy("sub").agg(F.count(F.lit(1)).cast("double").alias("total"))
    return sums.join(F.broadcast(counts), "sub").select("sub", *CELL, (F.col("w") * (F.lit(float(size**3)) / F.col("total")) - 1).alias("val"))  # a row a sub-box


def own_boxes(points: DataFrame, n: int, parts: int) -> DataFrame:
    """(sub, i, j, k, val): the same with each sub-box a periodic mesh of its own, dense, in one pass."""
    size = n // parts
    own = points.withColumn("sub", sum((F.floor((F.col(a) - 1) / size).cast("int") * parts**p for p, a in enumerate(AXES)), F.lit(0)))
    own = own.select("sub", *[(F.col(a) - F.floor((F.col(a) - 1) / size) * size).alias(a) for a in AXES])
    sums = corners(own, size).groupBy("sub", *CELL).agg(F.sum("w").alias("w"))
    counts = F.broadcast(own.groupBy("sub").agg(F.count(F.lit(1)).cast("double").alias("total")))  # a row a sub-box
    every = nodes(points.sparkSession, size).crossJoin(counts)
    full = every.join(sums, ["sub", *CELL], "left")
    return full.select("sub", *CELL, (F.coalesce("w", F.lit(0.0)) * (F.lit(float(size**3)) / F.col("total")) - 1).alias("val"))


def lattice(spark: SparkSession, n: int, shift: float = 0.05) -> DataFrame:
    """A particle beside each node: a uniform density."""
    return nodes(spark, n).select(((F.col("i") - 1).cast("long") * n * n + (F.col("j") - 1) * n + F.col("k") - 1).alias("id"), *[(F.col(c) + shift).alias(a) for a, c in zip(AXES, CELL, strict=True)])


def sphere(spark: SparkSession, n: int, inside: float = 0.5) -> DataFrame:
    """An overdense sphere of a tenth of the box, and around it what makes the mean zero."""
    middle = n / 2 + 0.5
    near = sum(((F.col(c) - middle) * (F.col(c) - middle) for c in CELL), F.lit(0.0)) < (0.1 * n) ** 2
    marked = nodes(spark, n).withColumn("inside", near)
    count = marked.agg(F.count_if("inside").alias("n_in"))
    rest = -inside * F.col("n_in") / (F.lit(float(n**3)) - F.col("n_in"))
    return marked.crossJoin(F.broadcast(count)).select(*CELL, F.when(F.col("inside"), inside).otherwise(rest).alias("val"))
