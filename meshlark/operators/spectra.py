"""Fourier transforms of meshes and what is measured on them.

A transform runs along one axis at a time: the mesh is packed into pencils (all values along the axis for one pair of the
other two), every task transforms the pencils it has by one vectorised call, and the shuffle to the next axis' pencils is
the transposition.  A mesh of up to WHOLE cells along an axis is transformed in one task instead: its size is fixed.

delta_k = sum(delta exp(-ikx)) / n**3 over all n**3 modes; wave numbers are min(i, n - i) in units of 2 pi / box.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlark.operators import mesh as M

WHOLE = 64
CELL = M.CELL


def _batch(i, j, k, z: np.ndarray) -> pa.RecordBatch:
    ints = [pa.array(x.astype(np.int32)) for x in (i, j, k)]
    return pa.RecordBatch.from_arrays([*ints, pa.array(np.ascontiguousarray(z.real)), pa.array(np.ascontiguousarray(z.imag))], [*CELL, "re", "im"])


SCHEMA = "i int, j int, k int, re double, im double"


def _whole(mesh: DataFrame, n: int, inverse: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = np.zeros((n, n, n), complex)
        seen = False
        for b in batches:
            seen = True
            i, j, k, re, im = (b.column(c).to_numpy() for c in range(5))
            z[i - 1, j - 1, k - 1] = re + 1j * im
        if seen:
            z = np.fft.ifftn(z) * n**3 if inverse else np.fft.fftn(z) / n**3
            i, j, k = (x.ravel() + 1 for x in np.indices((n, n, n)))
            yield _batch(i, j, k, z.ravel())

    return mesh.repartition(1).mapInArrow(run, SCHEMA)


def _pencils(mesh: DataFrame, axis: str, n: int, inverse: bool) -> DataFrame:
    others = [c for c in CELL if c != axis]
    packed = mesh.groupBy(*others).agg(F.array_sort(F.collect_list(F.struct(axis, "re", "im"))).alias("p"))
    packed = packed.select(*others, F.transform("p", lambda x: x["re"]).alias("re"), F.transform("p", lambda x: x["im"]).alias("im"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            z = np.asarray(b.column(2).flatten()).reshape(-1, n) + 1j * np.asarray(b.column(3).flatten()).reshape(-1, n)
            z = np.fft.ifft(z, axis=1) * n if inverse else np.fft.fft(z, axis=1) / n
            at = {others[0]: np.repeat(b.column(0).to_numpy(), n), others[1]: np.repeat(b.column(1).to_numpy(), n), axis: np.tile(np.arange(1, n + 1), len(z))}
            yield _batch(at["i"], at["j"], at["k"], z.ravel())

    return packed.mapInArrow(run, SCHEMA)


def fft3(mesh: DataFrame, n: int, inverse: bool = False, whole: bool | None = None) -> DataFrame:
    """(i, j, k, re, im): the transform of a dense mesh (i, j, k, re, im); inverse undoes forward."""
    if n <= WHOLE if whole is None else whole:
        return _whole(mesh.select(*CELL, "re", "im"), n, inverse)
    for axis in CELL:
        mesh = _pencils(mesh, axis, n, inverse)
    return mesh


def transform(mesh: DataFrame, n: int, whole: bool | None = None) -> DataFrame:
    """The transform of a real mesh (i, j, k, val)."""
    return fft3(mesh.select(*CELL, F.col("val").alias("re"), F.lit(0.0).alias("im")), n, whole=whole)


def transforms(meshes: DataFrame, n: int, by: str) -> DataFrame:
    """(by, i, j, k, re, im): transforms of real meshes (by, i, j, k, val) of up to WHOLE cells an axis, a task each."""
    if n > WHOLE:
        raise ValueError(f"several meshes of over {WHOLE} cells: transform them one by one")
    kind = dict(meshes.dtypes)[by]

    def run(mesh: pa.Table) -> pa.Table:
        z = np.zeros((n, n, n), complex)
        i, j, k, val = (mesh.column(c).to_numpy() for c in (*CELL, "val"))
        z[i - 1, j - 1, k - 1] = val
        i, j, k = (x.ravel() + 1 for x in np.indices((n, n, n)))
        out = pa.Table.from_batches([_batch(i, j, k, (np.fft.fftn(z) / n**3).ravel())])
        return out.add_column(0, by, pa.repeat(mesh.column(by)[0], len(out)))

    return meshes.select(by, *CELL, "val").groupBy(by).applyInArrow(run, f"{by} {kind}, {SCHEMA}")


def dft3(mesh: DataFrame, n: int) -> DataFrame:
    """The same as joins with a table of sines: an axis at a time, for meshes small enough to check others by."""
    spark = mesh.sparkSession
    angle = F.lit(-2 * pi / n) * F.pmod(F.col("a") * F.col("b"), F.lit(n))
    table = spark.range(n).select(F.col("id").alias("a")).crossJoin(spark.range(n).select(F.col("id").alias("b"))).select("a", "b", F.cos(angle).alias("c"), F.sin(angle).alias("s"))
    out = mesh.select(*CELL, F.col("val").alias("re"), F.lit(0.0).alias("im"))
    for axis in CELL:
        others = [c for c in CELL if c != axis]
        joined = out.join(F.broadcast(table), F.col(axis) - 1 == F.col("a"))  # n * n rows
        re, im = F.sum(F.col("re") * F.col("c") - F.col("im") * F.col("s")), F.sum(F.col("re") * F.col("s") + F.col("im") * F.col("c"))
        out = joined.groupBy(*others, (F.col("b") + 1).cast("int").alias(axis)).agg((re / n).alias("re"), (im / n).alias("im"))
    return out.select(*CELL, "re", "im")


def wave(c: Column, n: int) -> Column:
    """The size of a mode's wave number along an axis."""
    return F.least(c - 1, n - (c - 1)).cast("double")


def modes(spectrum: DataFrame, n: int) -> DataFrame:
    """(k, mu2, amp) of all modes but the mean; mu is the cosine to the third axis."""
    kx, ky, kz = (wave(F.col(c), n) for c in CELL)
    k2 = kx * kx + ky * ky + kz * kz
    out = spectrum.select("*", k2.alias("k2"), (kz * kz).alias("kz2")).where("k2 > 0")
    return out.withColumns({"k": F.sqrt("k2"), "mu2": F.col("kz2") / F.col("k2"), "amp": F.col("re") * F.col("re") + F.col("im") * F.col("im")})


def k_bin(k: Column) -> Column:
    return F.greatest(F.floor(k + 0.5), F.lit(1)).cast("long")


#: The factor of the quadrupole; the usual convention has 5.
QUADRUPOLE = 2.5


def power(spectrum: DataFrame, n: int, box: float, *by: str) -> DataFrame:
    """(by, bin, n_modes, k, p0, p2): means over shells of wave number, times the volume."""
    m = modes(spectrum, n)
    second = F.avg(F.col("amp") * (1.5 * F.col("mu2") - 0.5)) * QUADRUPOLE
    return m.groupBy(*by, k_bin(F.col("k")).alias("bin")).agg(F.count(F.lit(1)).alias("n_modes"), (F.avg("k") * (2 * pi / box)).alias("k"), (F.avg("amp") * box**3).alias("p0"), (second * box**3).alias("p2"))


def power_log(spectrum: DataFrame, n: int, box: float, width: float = 0.02) -> DataFrame:
    """The same in bins of log10 of the wave number."""
    m = modes(spectrum, n)
    return m.groupBy(F.floor(F.log10("k") / width).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n_modes"), (F.avg("k") * (2 * pi / box)).alias("k"), (F.avg("amp") * box**3).alias("p0"))


def power_shared(spectrum: DataFrame, n: int, box: float) -> DataFrame:
    """Each mode shared by the two shells around its wave number, linearly: (bin, weight, p0)."""
    m = modes(spectrum, n)
    low = F.floor("k")
    parts = F.array(F.struct(low.alias("bin"), (1 - (F.col("k") - low)).alias("w")), F.struct((low + 1).alias("bin"), (F.col("k") - low).alias("w")))
    return m.select("amp", F.inline(parts)).where("w > 0").groupBy("bin").agg(F.sum("w").alias("weight"), (F.sum(F.col("w") * F.col("amp")) / F.sum("w") * box**3).alias("p0"))


def corrected(spectra: DataFrame, n: int, box: float, points: float, value: str = "p0") -> DataFrame:
    """Power corrected for the assignment to cells and for shot noise."""
    s = F.sin(F.col("k") * (box / (2.0 * n)))
    return spectra.withColumn(value, F.col(value) / (1 - 0.6667 * s * s) - box**3 / points)


def green(n: int) -> Column:
    """Over the modes of a mesh: the inverse of the seven-point Laplacian, 0 for the mean."""
    parts = [F.cos(F.lit(2 * pi / n) * (F.col(c) - 1)) for c in CELL]
    lap = 2 * (parts[0] + parts[1] + parts[2]) - 6
    mean = (F.col("i") == 1) & (F.col("j") == 1) & (F.col("k") == 1)
    return F.when(mean, F.lit(0.0)).otherwise(1 / F.when(mean, F.lit(1.0)).otherwise(lap))


def potential(density: DataFrame, n: int, factor: float = 1.0, whole: bool | None = None) -> DataFrame:
    """(i, j, k, val) whose seven-point Laplacian is factor times the density's contrast."""
    spectrum = transform(density, n, whole)
    g = green(n) * factor
    return fft3(spectrum.withColumns({"re": F.col("re") * g, "im": F.col("im") * g}), n, inverse=True, whole=whole).select(*CELL, F.col("re").alias("val"))


def normal(key: Column, seed: int = 0) -> Column:
    """Standard normal numbers that depend on the key and seed alone."""
    u = [(F.pmod(F.xxhash64(F.lit(seed), F.lit(p), key), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52) for p in (1, 2)]
    return F.sqrt(-2 * F.log(u[0])) * F.cos(2 * pi * u[1])


def random_field(spark: SparkSession, n: int, box: float, spectrum: Column, seed: int = 1, fixed: bool = False, reverse: bool = False, whole: bool | None = None) -> DataFrame:
    """(i, j, k, re, im): modes of a Gaussian field; spectrum is the power as a function of the column k.

    fixed: all amplitudes are the expected ones and only the phases are random; reverse: the opposite phases.
    """
    node = F.col("i").cast("long") + n * (F.col("j") + n * F.col("k").cast("long"))
    white = transform(M.nodes(spark, n).select(*CELL, normal(node, seed).alias("val")), n, whole)
    kx, ky, kz = (wave(F.col(c), n) for c in CELL)
    out = white.withColumn("q", F.sqrt(kx * kx + ky * ky + kz * kz) * (2 * pi / box))
    size = F.sqrt(F.greatest(F.col("re") * F.col("re") + F.col("im") * F.col("im"), F.lit(1e-300)))
    norm = (1.0 if not reverse else -1.0) / (size if fixed else F.lit(float(n) ** -1.5))
    scale = out.withColumnRenamed("k", "kk").withColumnRenamed("q", "k").withColumn("s", F.when(F.col("k") > 0, F.sqrt(spectrum / box**3)).otherwise(0.0)).withColumnRenamed("k", "q").withColumnRenamed("kk", "k")
    return scale.withColumns({"re": F.col("re") * norm * F.col("s"), "im": F.col("im") * norm * F.col("s")}).select(*CELL, "re", "im")


def displacements(field: DataFrame, n: int, whole: bool | None = None) -> DataFrame:
    """(i, j, k, sx, sy, sz) in cells: the gradient of the field's inverse Laplacian, an inverse transform an axis."""
    signed = {c: F.when(F.col(c) - 1 <= n / 2, F.col(c) - 1).otherwise(F.col(c) - 1 - n).cast("double") for c in CELL}
    k2 = signed["i"] * signed["i"] + signed["j"] * signed["j"] + signed["k"] * signed["k"]
    out = None
    for axis, name in zip(CELL, ("sx", "sy", "sz"), strict=True):
        # i k / k2, but for the mean and the axis' highest mode, which has no sign
        f = F.when((k2 == 0) | (F.col(axis) - 1 == n / 2), F.lit(0.0)).otherwise(signed[axis] / k2) * (n / (2 * pi))
        part = fft3(field.select(*CELL, (-F.col("im") * f).alias("re"), (F.col("re") * f).alias("im")), n, inverse=True, whole=whole).select(*CELL, F.col("re").alias(name))
        out = part if out is None else out.join(part, list(CELL))
    return out


def zeldovich(moves: DataFrame, n: int, growth: float, speed: float) -> DataFrame:
    """Particles of a lattice moved by growth times its displacements, with velocities speed times them."""
    key = (F.col("i") - 1).cast("long") * n * n + (F.col("j") - 1) * n + F.col("k") - 1
    at = [M.wrap(F.col(c) + growth * F.col(s), n).alias(a) for c, s, a in zip(CELL, ("sx", "sy", "sz"), M.AXES, strict=True)]
    return moves.select(key.alias("id"), *at, *[(speed * F.col(s)).alias(f"v{a}") for s, a in zip(("sx", "sy", "sz"), M.AXES, strict=True)])
