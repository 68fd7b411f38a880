"""Multigrid relaxation of nonlinear scalar fields on periodic meshes (full approximation storage).

A model states an operator of the field whose zero is wanted, and a smoother that solves it node by node for one parity.
On a coarse level the wanted value isn't zero but L(R u) - R r, so that a solved fine level leaves the coarse one as it is.

Levels are dense arrays.  A mesh of up to LARGEST cells along an axis, a fixed bound, is solved in one task; larger ones
are rows of blocks that exchange their margins, with the same result (`blocks`).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlark.functions.cosmology import runge_kutta
from meshlark.operators import mesh as M

LARGEST = 64
LIGHT = 2997.92458  # c / (100 km/s)


def near(u: np.ndarray, *steps: tuple[int, int]) -> np.ndarray:
    """u as seen from each node at steps (axis, distance)."""
    for axis, d in steps:
        u = np.roll(u, -d, axis)
    return u


def six(u: np.ndarray) -> np.ndarray:
    return sum(near(u, (axis, d)) for axis in range(3) for d in (-1, 1))


def curvature(u: np.ndarray, axis: int) -> np.ndarray:
    return near(u, (axis, 1)) + near(u, (axis, -1)) - 2 * u


def cross(u: np.ndarray, a: int, b: int) -> np.ndarray:
    return near(u, (a, 1), (b, 1)) + near(u, (a, -1), (b, -1)) - near(u, (a, 1), (b, -1)) - near(u, (a, -1), (b, 1))


def slope(u: np.ndarray, axis: int) -> np.ndarray:
    return near(u, (axis, 1)) - near(u, (axis, -1))


PAIRS = ((0, 1), (0, 2), (1, 2))


@dataclass
class Model:
    """operator(u, rho, dx), and solved(u, rho, wanted, dx): the nodes' values that make the operator as wanted.

    A balanced model takes the mean of its source out: the mean that is given, or that of the arrays.
    """

    om: float = 0.3
    a: float = 1.0
    positive: bool = False
    balanced: bool = False

    def start(self) -> float:
        return 0.0

    def operator(self, u, rho, dx, mean=None):
        raise NotImplementedError

    def derivative(self, u, rho, dx):
        raise NotImplementedError

    def solved(self, u, rho, wanted, dx, mean=None):
        """One Newton step."""
        return u - (self.operator(u, rho, dx, mean) - wanted) / self.derivative(u, rho, dx)


@dataclass
class CurvatureGravity(Model):
    """f(R): u**(n + 1) is the size of f_R against its background; an equation of power n + 2 at each node."""

    n: int = 0
    f0: float = -1e-5
    box: float = 250.0
    cells: int = 32
    positive: bool = True

    def __post_init__(self):
        oml = 1 - self.om
        ricci, today = 3 * (self.om / self.a**3 + 4 * oml), 3 * (self.om + 4 * oml)
        self.background = abs(self.f0) * (today / ricci) ** (self.n + 1)
        self.per_dx2 = 1.0 / (LIGHT * self.cells / self.box) ** 2
        self.mass = ricci * self.a**2 / 3

    def start(self):
        return self.background ** (1 / (self.n + 1))

    def factors(self, dx):
        f = dx * dx * self.per_dx2
        return f * self.om / self.a, f * self.mass, f * self.mass * self.start()

    def operator(self, u, rho, dx, mean=None):
        """Laplacian of u**(n+1) less its source; rho is the density's contrast."""
        g, m, q = self.factors(dx)
        p = u ** (self.n + 1)
        return (six(p) - 6 * p - g * rho - m + q / u) / (dx * dx)

    def solved(self, u, rho, wanted, dx, mean=None):
        g, m, q = self.factors(dx)
        linear = (g * rho + m + wanted * dx * dx - six(u ** (self.n + 1))) / 6
        if self.n == 0:  # u**2 + linear u - q / 6 = 0
            return (-linear + np.sqrt(linear * linear + 4 * q / 6)) / 2
        x = np.maximum(u, np.abs(linear) ** (1 / (self.n + 1)) + q ** (1 / (self.n + 2)))
        for _ in range(60):  # from above: the function is convex and has one positive root
            x = x - (x ** (self.n + 2) + linear * x - q / 6) / ((self.n + 2) * x ** (self.n + 1) + linear)
        return x


@dataclass
class Symmetron(Model):
    """Lap u = (rho_c a**3 ... ) u + u**3 - u, in units of its vacuum value: a cubic at each node."""

    range_: float = 1.0
    a_break: float = 0.5
    box: float = 250.0
    cells: int = 32
    positive: bool = True

    def start(self):
        return max(1 - (self.a_break / self.a) ** 3, 1e-6) ** 0.5

    def factor(self, dx):
        return (self.a * dx * self.box / self.cells / self.range_) ** 2 / 2

    def operator(self, u, rho, dx, mean=None):
        f = self.factor(dx)
        return (six(u) - 6 * u - f * (((self.a_break / self.a) ** 3 * (1 + rho) - 1) * u + u**3)) / (dx * dx)

    def solved(self, u, rho, wanted, dx, mean=None):
        f = self.factor(dx)
        p = (self.a_break / self.a) ** 3 * (1 + rho) - 1 + 6 / f
        q = (wanted * dx * dx - six(u)) / f
        return cubic_root(p, q)


def cubic_root(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The root of x**3 + p x + q: the only real one, or the largest of three."""
    inner = (q / 2) ** 2 + (p / 3) ** 3
    root = np.sqrt(np.maximum(inner, 0))
    one = np.cbrt(-q / 2 + np.where(q < 0, root, -root))
    one = np.where(one != 0, one - p / (3 * np.where(one != 0, one, 1)), 0)
    r = np.sqrt(np.maximum(-p / 3, 1e-60))
    three = 2 * r * np.cos(np.arccos(np.clip(-q / 2 / r**3, -1, 1)) / 3)
    return np.where(inner >= 0, one, three)


@dataclass
class BraneWorld(Model):
    """DGP: the square of second derivatives as source; Newton with the Laplacian's derivative.

    A periodic Laplacian has mean zero, so the source's mean is taken out; else no field solves the equation.
    """

    crossing: float = 1.0
    normal: bool = True
    balanced: bool = True

    def __post_init__(self):
        orc = 1 / (4 * self.crossing**2)
        m = self.om / self.a**3
        rest = 1 - self.om if self.normal else orc
        root = (m / 2 + rest) / (orc * (m + rest)) ** 0.5
        self.beta = 1 + root if self.normal else -root
        self.alpha = 3 * self.beta * self.a**2 * 4 * orc

    def source(self, u, rho, dx):
        c = [curvature(u, axis) for axis in range(3)]
        s = sum(x * x for x in c) - sum(c[i] * c[j] for i, j in PAIRS)
        s = (s * 2 / 3 + sum(cross(u, i, j) ** 2 for i, j in PAIRS) / 8) / dx**4 + self.alpha * self.om / self.beta / self.a * rho
        return 0.75 * (np.sign(self.alpha) * np.sqrt(np.maximum(self.alpha**2 + 8 / 3 * s, 0)) - self.alpha)

    def operator(self, u, rho, dx, mean=None):
        source = self.source(u, rho, dx)
        return (six(u) - 6 * u) / dx**2 - (source - (source.mean() if mean is None else mean))

    def derivative(self, u, rho, dx):
        return -6.0 / dx**2


@dataclass
class CoupledScalar(Model):
    """Lap u = 3 Om / a (A'(phi) rho - A'(phi0)) + a**2 (V'(phi) - V'(phi0)), phi = phi0 + u / c**2."""

    coupling: float = -0.1
    power: float = 0.1
    lambda2: float = 2.0
    phi0: float = 1.0
    box: float = 250.0
    cells: int = 32

    def terms(self, u, rho):
        c2 = (LIGHT * self.cells / self.box) ** 2
        phi = np.maximum(self.phi0 + u / c2, 1e-6)
        a1 = self.coupling * np.exp(self.coupling * phi)
        v1 = -self.power * self.lambda2 * self.a**2 / phi ** (1 + self.power)
        return phi, a1, v1, c2

    def operator(self, u, rho, dx, mean=None):
        _, a1, v1, _ = self.terms(u, rho)
        _, a0, v0, _ = self.terms(0.0, 0.0)
        return (six(u) - 6 * u) / dx**2 - 3 * self.om / self.a * (a1 * (1 + rho) - a0) - (v1 - v0)

    def derivative(self, u, rho, dx):
        phi, a1, v1, c2 = self.terms(u, rho)
        return -6 / dx**2 - 3 * self.om / self.a * (1 + rho) * self.coupling * a1 / c2 + (1 + self.power) * v1 / c2 / phi


@dataclass
class KineticScreening(Model):
    """k-mouflage: the field's gradients weaken the source; n is 2 or 3."""

    n: int = 2
    k0: float = 0.1
    strength: float = 0.1
    lambda_: float = 1.5
    velocity: float = 0.1
    box: float = 250.0
    cells: int = 32

    def parts(self, u, rho, dx):
        c = LIGHT * self.cells / self.box
        g = [slope(u, axis) for axis in range(3)]
        grad2 = sum(x * x for x in g) / (4 * dx * dx)
        gamma = self.n * self.k0 * (0.5 / (self.a * self.lambda_) ** 2) ** (self.n - 1)
        weight = 1 + gamma * ((2 * self.n + 1) / 3 * grad2 ** (self.n - 1) + self.velocity ** (2 * (self.n - 1)))
        c2 = [curvature(u, axis) for axis in range(3)]
        shear = sum(g[i] ** 2 * (2 * c2[i] - sum(c2[j] for j in range(3) if j != i)) for i in range(3)) / 12
        shear = (shear + sum(cross(u, i, j) * g[i] * g[j] for i, j in PAIRS) / 8) / dx**4
        extra = -gamma * (self.n - 1) * 2 * c * grad2 ** (self.n - 2) * shear
        return weight, (3 * self.strength * self.om / self.a * rho + extra) / c

    def operator(self, u, rho, dx, mean=None):
        weight, source = self.parts(u, rho, dx)
        return (six(u) - 6 * u) / dx**2 - source / weight

    def derivative(self, u, rho, dx):
        return -6.0 / dx**2


MODELS = {1: CurvatureGravity, 2: BraneWorld, 3: Symmetron, 4: KineticScreening, 5: CoupledScalar}


# ---- cycles -----------------------------------------------------------------------------------------------------------


def restricted(x: np.ndarray) -> np.ndarray:
    n = len(x) // 2
    return x.reshape(n, 2, n, 2, n, 2).mean(axis=(1, 3, 5))


def prolonged(x: np.ndarray) -> np.ndarray:
    """Trilinear: along each axis 3/4 of the parent and 1/4 of the next one on the child's side."""
    for axis in range(3):
        low, high = 0.75 * x + 0.25 * near(x, (axis, -1)), 0.75 * x + 0.25 * near(x, (axis, 1))
        shape = list(x.shape)
        shape[axis] *= 2
        x = np.stack([low, high], axis + 1).reshape(shape)
    return x


def relax(model: Model, u, rho, wanted, dx, sweeps: int = 2):
    """Gauss-Seidel sweeps: nodes of odd index sums, then of even ones."""
    parity = np.indices(u.shape).sum(axis=0) % 2
    for _ in range(sweeps):
        for p in (0, 1):
            u = np.where(parity == p, model.solved(u, rho, wanted, dx), u)
    return u


def cycle(model: Model, u, rho, wanted, dx: float = 1.0, kind: str = "V", smallest: int = 4):
    """One V, F or W cycle."""
    if len(u) <= smallest or len(u) % 2:
        return relax(model, u, rho, wanted, dx, 8)
    u = relax(model, u, rho, wanted, dx)
    rho2, u2 = restricted(rho), restricted(u)
    wanted2 = model.operator(u2, rho2, 2 * dx) + restricted(wanted - model.operator(u, rho, dx))
    v2 = u2
    for k in {"V": "V", "F": "FV", "W": "WW"}[kind]:
        v2 = cycle(model, v2, rho2, wanted2, 2 * dx, k, smallest)
    better = u + prolonged(v2 - u2)
    if model.positive:
        better = np.where(better > 0, better, u)
    return relax(model, better, rho, wanted, dx)


@dataclass
class Solution:
    field: np.ndarray
    residuals: list[float] = field(default_factory=list)


def solve(model: Model, rho: np.ndarray, kind: str = "V", most: int = 12, enough: float = 1e-9) -> Solution:
    """Cycles until the rms residual is small enough or stalls (under 0.5 % less than before, after two cycles)."""
    u = np.full(rho.shape, model.start())
    zero = np.zeros(rho.shape)
    out = Solution(u)
    for k in range(most):
        u = cycle(model, u, rho, zero, kind=kind)
        out.residuals.append(float(np.sqrt(np.mean(model.operator(u, rho, 1.0) ** 2))))
        out.field = u
        if settled(out.residuals, k, enough):
            break
    return out


def settled(residuals: list[float], k: int, enough: float) -> bool:
    """Whether cycles end: the residual is small enough; or, after two cycles, it fell by under 0.5 %, or twice by under 1 %."""
    if residuals[-1] <= enough:
        return True
    if k < 2:
        return False
    falls = [after / before for before, after in zip(residuals, residuals[1:], strict=False)]
    return falls[-1] > 0.995 or all(f > 0.99 for f in falls[-2:])


def scalar_field(mesh: DataFrame, n: int, model: Model, kind: str = "V", most: int = 12) -> DataFrame:
    """(i, j, k, val, residual) of a dense mesh (i, j, k, val): in one task up to LARGEST cells along an axis, else by blocks."""
    if n > LARGEST:
        from meshlark.streaming import blocks

        return blocks.solve(mesh, n, model, kind, most)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rho, seen = np.zeros((n, n, n)), False
        for b in batches:
            i, j, k, v = (b.column(c).to_numpy() for c in range(4))
            rho[i - 1, j - 1, k - 1], seen = v, True
        if seen:
            s = solve(model, rho, kind, most)
            at = [pa.array((x.ravel() + 1).astype(np.int32)) for x in np.indices(rho.shape)]
            res = model.operator(s.field, rho, 1.0)
            yield pa.RecordBatch.from_arrays([*at, pa.array(s.field.ravel()), pa.array(res.ravel())], ["i", "j", "k", "val", "residual"])

    return mesh.select(*M.CELL, "val").repartition(1).mapInArrow(run, "i int, j int, k int, val double, residual double")


def sweep_quadratic(state: DataFrame, n: int, parity: int, g: float, m: float, q: float) -> DataFrame:
    """state (i, j, k, rho, u) with u solved from u**2 + p u - q = 0 at nodes of a parity, p from the six neighbours."""
    around = M.shifted(state, M.OFFSETS_6, n, "u").where(F.pmod(F.col("i") + F.col("j") + F.col("k"), F.lit(2)) == parity).groupBy(*M.CELL).agg(F.sum("near").alias("s"))
    p = g * F.col("rho") + m - F.col("s") / 6
    fresh = (-p + F.sqrt(p * p + 4 * q)) / 2
    return state.join(around, list(M.CELL), "left").select(*M.CELL, "rho", F.when(F.col("s").isNull(), F.col("u")).otherwise(fresh).alias("u"))


def residual_quadratic(state: DataFrame, n: int, g: float, m: float, q: float) -> DataFrame:
    """(rms, n): of u + q / ... at all nodes: what the sweep's equation leaves, over u."""
    around = M.shifted(state, M.OFFSETS_6, n, "u").groupBy(*M.CELL).agg(F.sum("near").alias("s"))
    own = state.join(around, list(M.CELL))
    r = F.col("s") / 6 - F.col("u") - g * F.col("rho") - m + q / F.col("u")
    return own.agg(F.sqrt(F.avg(r * r)).alias("rms"), F.count(F.lit(1)).alias("n"))


def add_fifth_force(potential: DataFrame, scalar: DataFrame, factor: float, power: int = 1) -> DataFrame:
    """potential + factor * scalar**power, node by node."""
    own = scalar.select(*M.CELL, F.pow("val", F.lit(float(power))).alias("__s"))
    return potential.join(own, list(M.CELL)).select(*M.CELL, (F.col("val") + factor * F.col("__s")).alias("val"))


# ---- background -------------------------------------------------------------------------------------------------------


def evolve_background(om: float, coupling: float, power: float, lambda2: float, phi: float = 1e-2, steps: int = 4000) -> list[tuple[float, float, float, float]]:
    """(a, phi, dphi/dlna, H/H0) of a scalar with an inverse power potential, coupled to matter, from a = 1e-4 on."""

    def hubble2(n: float, y: np.ndarray) -> float:
        return (om * np.exp(-3 * n) * np.exp(coupling * y[0]) + lambda2 / y[0] ** power / 3) / (1 - y[1] ** 2 / 6)

    def rhs(n: float, y: np.ndarray) -> np.ndarray:
        y = np.array([max(y[0], 1e-8), np.clip(y[1], -2.4, 2.4)])
        h2 = hubble2(n, y)
        matter = om * np.exp(-3 * n) * np.exp(coupling * y[0])
        dln = -1.5 * matter / h2 - y[1] ** 2 / 2
        return np.array([y[1], -(3 + dln) * y[1] + (power * lambda2 / y[0] ** (power + 1) - 3 * coupling * matter) / h2])

    return [(float(np.exp(n)), float(y[0]), float(y[1]), float(hubble2(n, y) ** 0.5)) for n, y in runge_kutta(rhs, np.log(1e-4), 0.0, np.array([phi, 0.0]), steps)]


def background(om: float, coupling: float, power: float) -> list[tuple[float, float, float, float]]:
    """The evolution whose potential makes H = H0 today: found by halving."""
    low, high = 0.1, 10.0
    for _ in range(40):
        mid = (low + high) / 2
        now = evolve_background(om, coupling, power, mid, steps=1500)[-1][3]
        low, high = (mid, high) if now < 1 else (low, mid)
    return evolve_background(om, coupling, power, (low + high) / 2)
