"""Range joins in a periodic box: an equi-join on cells, then a filter by distance.

Catalyst doesn't turn a distance predicate into an equi-join, so `within` does: rows of the left side are sent to the
cells around them, rows of the right side to their own, and AQE deals with crowded cells.  Distances are to the nearest
image, so no copies of rows near the walls are needed; `ghosts` makes them for those who want a plain join.

`recentre` needs only sums of what lies around a row: there, rows of a block are packed, blocks meet by the same join, and
pairs are found in numpy and never leave their task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlark.functions.storage import cut

AXES = ("x", "y", "z")
CELLS = ("ci", "cj", "ck")
#: Rows that are packed together; a block of more is packed in parts, and every two parts of a block meet.
PART = 1 << 17
#: Distances that a task holds at once.
PAIRS = 1 << 16


def cell(c: Column, size: float, count: int) -> Column:
    """The cell of a coordinate in [0, box)."""
    return F.least(F.greatest(F.floor(c / size), F.lit(0)), F.lit(count - 1)).cast("int")


def cells(df: DataFrame, size: float, count: int, names=("ci", "cj", "ck")) -> DataFrame:
    return df.withColumns({n: cell(F.col(a), size, count) for n, a in zip(names, AXES, strict=True)})


def probes(df: DataFrame, reach: Column, size: float, count: int, periodic: bool = True, names=("ci", "cj", "ck")) -> DataFrame:
    """Each row once for every cell that a cube of half-width reach around it touches."""
    out = df
    for n, a in zip(names, AXES, strict=True):
        low, high = F.floor((F.col(a) - reach) / size).cast("int"), F.floor((F.col(a) + reach) / size).cast("int")
        if periodic:  # no cell twice, however far the reach
            places = F.transform(F.sequence(low, F.least(high, low + F.lit(count - 1))), lambda i: F.pmod(i, F.lit(count)))
        else:
            places = F.sequence(F.greatest(low, F.lit(0)), F.greatest(F.least(high, F.lit(count - 1)), F.greatest(low, F.lit(0))))
        out = out.withColumn(n, F.explode(places))
    return out


def nearest_image(d: Column, box: float) -> Column:
    return F.when(d > box / 2, d - box).when(d < -box / 2, d + box).otherwise(d)


def distance2(box: float | None, a: str = "a", b: str = "b") -> Column:
    """The square of a distance; each part is that of nearest_image but for its sign, and shorter, as joins repeat their texts."""
    parts = [F.col(f"{b}.{c}") - F.col(f"{a}.{c}") for c in AXES]
    parts = [p if box is None else F.least(F.abs(p), F.lit(box) - F.abs(p)) for p in parts]
    return parts[0] * parts[0] + parts[1] * parts[1] + parts[2] * parts[2]


def within(left: DataFrame, right: DataFrame, reach: Column | float, box: float, size: float, periodic: bool = True, how: str = "inner", extra: Column | None = None) -> DataFrame:
    """Pairs (a.*, b.*, d2) with d2 < reach**2; reach may use columns of left.  size: the cells' side.

    how: inner, or left_semi and left_anti against left rows by id (a row probes several cells, so these go by id).
    """
    count = int(box / size)
    size = box / count
    r = F.lit(float(reach)) if isinstance(reach, (int, float)) else reach
    a = probes(left.withColumn("__r", r), F.col("__r"), size, count, periodic).alias("a")
    # probes are many times the rows that their size is guessed from, so no side is left to be broadcast: each task hashes its
    # rows of right, and probes, the many, stream past them unsorted
    b = cells(right, size, count).alias("b").hint("shuffle_hash")
    d2 = distance2(box if periodic else None)
    same = (F.col("a.ci") == F.col("b.ci")) & (F.col("a.cj") == F.col("b.cj")) & (F.col("a.ck") == F.col("b.ck"))
    near = d2 < F.col("a.__r") * F.col("a.__r")
    on = same & near if extra is None else same & near & extra
    if how == "inner":
        return a.join(b, on).withColumn("d2", d2)
    hits = a.join(b, on, "left_semi").select("id").distinct()
    return left.join(hits, "id", how)


def ghosts(df: DataFrame, box: float, buffer: float) -> DataFrame:
    """All images of rows within the box and a buffer around it, with is_ghost."""
    shifts = [-1, 0, 1]
    to = F.array(*[F.struct(F.lit(a * box).alias("sx"), F.lit(b * box).alias("sy"), F.lit(c * box).alias("sz")) for a in shifts for b in shifts for c in shifts])
    out = df.select("*", F.inline(to)).withColumns({c: F.col(c) + F.col(f"s{c}") for c in AXES})
    inside = [(F.col(c) >= -buffer) & (F.col(c) < box + buffer) for c in AXES]
    ghost = (F.col("sx") != 0) | (F.col("sy") != 0) | (F.col("sz") != 0)
    return out.where(inside[0] & inside[1] & inside[2]).withColumn("is_ghost", ghost).drop("sx", "sy", "sz")


def drop_ghosts(df: DataFrame) -> DataFrame:
    return df.where(~F.col("is_ghost")).drop("is_ghost")


def shell(d2: Column, edges: list[float]) -> Column:
    """The number of edges that a distance, given squared, reaches; compared exactly, without logarithms."""
    return sum((F.when(d2 >= e * e, 1).otherwise(0) for e in edges), F.lit(0)).cast("long")


def pair_counts(df: DataFrame, box: float, edges: list[float], weight: str = "m", size: float | None = None, inner: float = 0.0) -> DataFrame:
    """(bin, pairs, weight): ordered pairs of distinct rows by distance, counted and weighted with the product of weights.

    inner: pairs nearer than that are left out.
    """
    each = F.col("a.id") < F.col("b.id")  # each pair once
    pairs = within(df, df, edges[-1], box, size or edges[-1], extra=each & (distance2(box) >= inner * inner) if inner else each)
    b = shell(F.col("d2"), edges).alias("bin")
    return pairs.select(b, (F.col(f"a.{weight}") * F.col(f"b.{weight}")).alias("w")).groupBy("bin").agg((2 * F.count(F.lit(1))).alias("pairs"), (2 * F.sum("w")).alias("weight"))


def correlation(df: DataFrame, box: float, edges: list[float], weight: str = "m") -> DataFrame:
    """(bin, pairs, xi, xi_weighted) of the shells between edges."""
    # a filter by bin would be moved into the join, with the distance written out for each edge: code too long to be compiled
    counts = pair_counts(df, box, edges, weight, inner=edges[0])
    total = df.agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(weight).alias("w"), F.sum(F.col(weight) * F.col(weight)).alias("w2"))
    pi = 3.141592653589793
    volume = F.get(F.array(F.lit(None).cast("double"), *[F.lit(4 * pi / 3 * (b**3 - a**3)) for a, b in zip(edges, edges[1:], strict=False)]), F.col("bin").cast("int"))
    out = counts.crossJoin(F.broadcast(total)).withColumn("dv", volume / F.lit(box**3))  # one row
    return out.select("bin", "pairs", (F.col("pairs") / (F.col("n") * F.col("n") * F.col("dv")) - 1).alias("xi"), (F.col("weight") / (F.col("w") * F.col("w") * F.col("dv")) - 1).alias("xi_weighted"))


def remove_contained(halos: DataFrame, box: float, size: float, periodic: bool = False) -> DataFrame:
    """Halos that lie within the radius r of no heavier one."""
    heavier = halos.select("id", *AXES, "r", "m")
    count = int(box / size)
    size = box / count
    a = probes(heavier.alias("q"), F.col("r"), size, count, periodic).alias("a")  # the heavier reaches out
    b = cells(halos.select("id", *AXES, "m"), size, count).alias("b")
    same = (F.col("a.ci") == F.col("b.ci")) & (F.col("a.cj") == F.col("b.cj")) & (F.col("a.ck") == F.col("b.ck"))
    inside = distance2(box if periodic else None) < F.col("a.r") * F.col("a.r")
    lost = b.join(a, same & inside & (F.col("b.m") < F.col("a.m")), "left_semi").select("id")
    return halos.join(lost, "id", "left_anti")


def remove_contained_simple(halos: DataFrame) -> DataFrame:
    """The same by a nested loop: the reading of the rule, for tests of small tables."""
    a, b = halos.alias("a"), halos.alias("b")
    return a.join(b, (distance2(None) < F.col("b.r") * F.col("b.r")) & (F.col("a.m") < F.col("b.m")), "left_anti")


def distinct_flag(halos: DataFrame, box: float, size: float) -> DataFrame:
    """halos with is_distinct: no heavier halo lies within a halo's own radius."""
    heavier = within(halos.select("id", *AXES, "m", "r"), halos.select("id", *AXES, "m"), F.col("r"), box, size, periodic=True, how="left_semi", extra=F.col("a.m") < F.col("b.m"))
    return halos.join(heavier.select("id", F.lit(False).alias("is_distinct")), "id", "left").withColumn("is_distinct", F.coalesce("is_distinct", F.lit(True)))


def _packed(placed: DataFrame, columns: list[str], name: str) -> DataFrame:
    """(ci, cj, ck, name): rows of a block, their columns of eight bytes one after the other; PART rows at most."""
    most = PART
    schema = pa.schema([*[(c, pa.int32()) for c in CELLS], (name, pa.binary())])

    def whole(at: tuple[int, ...], held: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*[pa.array([x], pa.int32()) for x in at], pa.array([np.concatenate(held, axis=1).tobytes()], pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, at = [], 0, None
        for b in batches:
            place = np.stack([b.column(c).to_numpy() for c in CELLS], axis=1)
            values = np.stack([b.column(c).to_numpy().view(np.float64) for c in columns])
            first = np.flatnonzero((np.diff(place, axis=0, prepend=place[:1] - 1) != 0).any(axis=1))
            for s, e in zip(first, np.append(first[1:], len(place)), strict=True):
                here = tuple(place[s].tolist())
                while s < e:
                    if held and (here != at or rows == most):
                        yield whole(at, held)
                        held, rows = [], 0
                    n = min(e - s, most - rows)
                    held.append(values[:, s : s + n])
                    s, rows, at = s + n, rows + n, here
        if held:
            yield whole(at, held)

    return placed.select(*CELLS, *columns).repartition(*CELLS).sortWithinPartitions(*CELLS).mapInArrow(run, f"ci int, cj int, ck int, {name} binary")


def _parts(x: np.ndarray, side: float, *also: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of x (3, n) by parts of that side (and by also), and where each part begins and ends in it."""
    at = ((x - x.min(axis=1, keepdims=True)) / side).astype(np.int64)
    keys = [*also, at[2], at[1], at[0]]
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= np.diff(k[order]) != 0
    first = np.flatnonzero(new)
    return order, first, np.append(first[1:], len(order))


def _around(halos: np.ndarray, points: np.ndarray, box: float) -> tuple[np.ndarray, np.ndarray]:
    """Of halos (id, x, y, z, reach) that have points (x, y, z, values) nearer than reach: ids, and a row each of sums.

    The sums: how many, the values, and the offsets to the nearest image.  Halos near each other are compared at once
    with the points of all parts of the block that are in reach of one of them.
    """
    h, p = halos[:, np.isfinite(halos[1:]).all(axis=0)], points[:, np.isfinite(points[:3]).all(axis=0)]
    if not h.shape[1] or not p.shape[1]:
        return halos[0, :0], np.zeros((0, points.shape[0] + 1))
    centre = (p[:3].min(axis=1) + p[:3].max(axis=1)) / 2
    image = np.round((h[1:4] - centre[:, None]) / box)
    at = h[1:4] - image * box  # beside the block
    wide = at.max(axis=1) - at.min(axis=1)
    reach = np.abs(h[4]).max()
    side = np.clip(np.cbrt(wide.prod() * 32 / h.shape[1]), reach / 8, reach * 2)  # about 32 halos a part
    side = max(side, wide.max() / 64, np.ptp(p[:3], axis=1).max() / 64, 1e-300)
    order, first, last = _parts(p[:3], side)
    p = np.concatenate([p[:3], np.ones((1, p.shape[1])), p[3:]])[:, order]
    finite = np.isfinite(p[4:]).all()
    low, high = np.minimum.reduceat(p[:3], first, axis=1), np.maximum.reduceat(p[:3], first, axis=1)
    mid, half = (low + high) / 2, (high - low) / 2
    order, begin, end = _parts(at, side, *image)
    h = h[:, order]
    ids, sums = [], []
    for s, e in zip(begin, end, strict=True):
        own, r = h[1:4, s:e], np.abs(h[4, s:e])
        low, high = own.min(axis=1), own.max(axis=1)
        here, most = (low + high) / 2, r.max()
        gap = mid - here[:, None]
        gap = np.maximum(np.abs(gap - box * np.round(gap / box)) - half - ((high - low) / 2)[:, None], 0.0)
        near = np.flatnonzero((gap * gap).sum(axis=0) <= (most * (1 + 1e-9) + box * 1e-12) ** 2)
        if not len(near):
            continue
        ends = np.flatnonzero(np.diff(near, append=-1) != 1)
        starts = np.append(0, ends[:-1] + 1)
        mine = np.concatenate([p[:, first[near[i]] : last[near[j]]] for i, j in zip(starts, ends, strict=True)], axis=1)
        alike = most + (high - low).max() < box / 2  # one image of a point is the nearest for all that have it in reach
        off = mine[:3] - here[:, None]
        shift = np.where(off > box / 2, box, np.where(off < -box / 2, -box, 0.0))
        step = max(1, PAIRS // mine.shape[1])
        for t in range(0, e - s, step):
            d = [mine[a] - own[a, t : t + step, None] for a in range(3)]
            if not alike:
                d = [np.where(x > box / 2, x - box, np.where(x < -box / 2, x + box, x)) for x in d]
            elif shift.any():
                d = [x - y for x, y in zip(d, shift, strict=True)]
            inside = d[0] * d[0] + d[1] * d[1] + d[2] * d[2] < (r[t : t + step] * r[t : t + step])[:, None]
            each = inside.astype(np.float64)
            total = each @ mine[3:].T if finite else np.stack([np.where(inside, x, 0.0).sum(axis=1) for x in mine[3:]], axis=1)
            some = np.flatnonzero(total[:, 0])
            ids.append(h[0, s:e][t : t + step][some])
            sums.append(np.concatenate([total, np.stack([np.einsum("hp,hp->h", each, x) for x in d], axis=1)], axis=1)[some])
    return (np.concatenate(ids), np.concatenate(sums)) if ids else (halos[0, :0], np.zeros((0, points.shape[0] + 1)))


def _sums(halos: DataFrame, points: DataFrame, reach: Column, box: float, size: float) -> DataFrame:
    """(id, n, kx.., wx.., dx..) of the points within reach of halos (ids are whole numbers), by blocks of the box.

    k, w: how many velocities are known, and their sum; d: the sum of the offsets.  A halo has a row for every two parts
    that hold it and points within its reach.
    """
    count = max(int(box / max(4 * size, box / 64)), 1)
    side = box / count
    own = halos.select(F.col("id").cast("long").alias("id"), *[F.col(a).cast("double").alias(a) for a in AXES], reach.cast("double").alias("reach"))
    known = [F.col(f"v{a}").isNotNull().cast("double").alias(f"k{a}") for a in AXES]
    speeds = [F.coalesce(F.col(f"v{a}").cast("double"), F.lit(0.0)).alias(f"w{a}") for a in AXES]
    placed = cells(points.select(*[F.col(a).cast("double").alias(a) for a in AXES], *known, *speeds).dropna(subset=list(AXES)), side, count)
    values = [*[f"k{a}" for a in AXES], *[f"w{a}" for a in AXES]]
    a = _packed(probes(own.dropna(), F.col("reach"), side, count), ["id", *AXES, "reach"], "halos").alias("a")
    b = _packed(placed, [*AXES, *values], "points").alias("b").hint("shuffle_hash")
    met = a.join(b, (F.col("a.ci") == F.col("b.ci")) & (F.col("a.cj") == F.col("b.cj")) & (F.col("a.ck") == F.col("b.ck")))
    names = ["n", *values, *[f"d{a}" for a in AXES]]
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), *[(c, pa.float64()) for c in names[1:]]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, p in zip(batch.column("halos"), batch.column("points"), strict=True):
                ids, sums = _around(*[np.frombuffer(x.as_buffer()).reshape(n, -1) for x, n in ((h, 5), (p, 3 + len(values)))], box)
                yield pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), pa.array(sums[:, 0].astype(np.int64)), *[pa.array(x) for x in sums.T[1:]]], schema=schema)

    return met.select("halos", "points").mapInArrow(run, "id long, n long, " + ", ".join(f"{c} double" for c in names[1:]))


def recentre(halos: DataFrame, points: DataFrame, reach: Column | float, box: float, size: float, least: int = 1) -> DataFrame:
    """Halos moved to the mean position and velocity of the points around them, with n; those with fewer than least stay.

    reach may use columns of halos.
    """
    means = _sums(halos, points, F.lit(float(reach)) if isinstance(reach, (int, float)) else reach, box, size).groupBy("id").agg(
        *[(F.sum(f"d{c}") / F.sum("n")).alias(f"d{c}") for c in AXES],
        *[(F.sum(f"w{c}") / F.nullif(F.sum(f"k{c}"), F.lit(0.0))).alias(f"w{c}") for c in AXES],
        F.sum("n").alias("n"),
    ).where(F.col("n") >= least)
    moved = {c: F.coalesce(F.col(f"h.{c}") + F.col(f"d{c}"), F.col(f"h.{c}")) for c in AXES}
    out = halos.alias("h").join(means, "id", "left")
    back = {c: F.when(moved[c] >= box, moved[c] - box).when(moved[c] < 0, moved[c] + box).otherwise(moved[c]) for c in AXES}
    return out.select("id", *[back[c].alias(c) for c in AXES], *[F.coalesce(f"w{c}", F.lit(0.0)).alias(f"v{c}") for c in AXES], F.coalesce("n", F.lit(0)).alias("n"))


def density_reach(density: Column, cell: float) -> Column:
    """Half to twice a cell, growing with the logarithm of the density at a maximum."""
    return cell * F.greatest(F.lit(0.5), F.least(F.lit(2.0), F.log10(density + 10) / 2))


def settle(halos: DataFrame, points: DataFrame, cell: float, box: float, passes: int = 4) -> DataFrame:
    """Maxima (id, x, y, z, density) moved in passes to the mean of the points within reach, where two or more are.

    With n and velocities of the last pass, as of recentre.
    """
    out = halos.select("id", *AXES, "density")
    for p in range(passes):
        moved = recentre(out, points, density_reach(F.col("density"), cell), box, 2 * cell, least=2)
        if p == passes - 1:
            return moved
        out = cut(moved.select("id", *AXES).join(halos.select("id", "density"), "id"))
    return recentre(out, points, 0.0, box, 2 * cell, least=2)
