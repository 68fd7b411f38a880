"""Scalar functions of cosmology.  Integrals run on the driver over fixed grids; Column functions stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Cosmology:
    omega_m: float = 0.3
    omega_l: float = 0.7
    hubble: float = 0.7
    sigma8: float = 0.8

    @property
    def omega_k(self) -> float:
        return 1.0 - self.omega_m - self.omega_l


def power_law(k: Column, amplitude: float = 2.0e4, turn: float = 0.02, slope: float = -1.5) -> Column:
    """A smooth spectrum with slope 1 at small k, for initial conditions without a table."""
    x = k / turn
    return F.lit(amplitude) * x * F.pow(1 + x * x, F.lit((slope - 1) / 2))


def cut_root(power: Column, k: Column, highest: float, tidy: Callable | None = None) -> Column:
    root = F.sqrt(power)
    return F.when(k <= highest, root if tidy is None else tidy(root)).otherwise(0.0)


def integrate(f: Callable[[np.ndarray], np.ndarray], a: float, b: float, n: int = 2000) -> float:
    """Simpson's rule with n (even) steps."""
    x = np.linspace(a, b, n + 1)
    y = f(x)
    return float((y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum()) * (b - a) / n / 3)


def adaptive(f: Callable[[float], float], a: float, b: float, tolerance: float = 1e-8, depth: int = 40) -> float:
    """Adaptive Gauss-Legendre quadrature: an interval is halved until eight points on it and on its halves agree."""
    x, w = np.polynomial.legendre.leggauss(8)

    def gauss(lo: float, hi: float) -> float:
        m, h = (lo + hi) / 2, (hi - lo) / 2
        return h * float(sum(wi * f(m + h * xi) for xi, wi in zip(x, w, strict=True)))

    def inner(lo: float, hi: float, whole: float, left: int) -> float:
        m = (lo + hi) / 2
        one, two = gauss(lo, m), gauss(m, hi)
        if left == 0 or abs(one + two - whole) <= tolerance * max(abs(one + two), 1e-300):
            return one + two
        return inner(lo, m, one, left - 1) + inner(m, hi, two, left - 1)

    return inner(a, b, gauss(a, b), depth)


def hubble_rate(c: Cosmology, a: np.ndarray) -> np.ndarray:
    """H / H0."""
    return np.sqrt(c.omega_m / a**3 + c.omega_k / a**2 + c.omega_l)


def growth(c: Cosmology, a: float) -> float:
    """The linear growth factor, a itself in a universe of matter alone."""
    inner = integrate(lambda x: np.where(x > 0, (np.maximum(x, 1e-30) * hubble_rate(c, np.maximum(x, 1e-30))) ** -3.0, 0.0), 0.0, a)
    return 2.5 * c.omega_m * float(hubble_rate(c, np.array(a))) * inner


def growth_ode(c: Cosmology, a: float, steps: int = 4000) -> float:
    """The same by integrating the growth equation from early times (Runge-Kutta in ln a)."""

    def rhs(n: float, y: np.ndarray) -> np.ndarray:
        x = np.exp(n)
        h2 = float(hubble_rate(c, np.array(x))) ** 2
        dln = (-3 * c.omega_m / x**3 - 2 * c.omega_k / x**2) / (2 * h2)
        return np.array([y[1], -(2 + dln) * y[1] + 1.5 * c.omega_m / x**3 / h2 * y[0]])

    start = np.log(1e-4)
    return float(runge_kutta(rhs, start, np.log(a), np.array([1e-4, 1e-4]), steps)[-1][1][0])


def age(c: Cosmology, a: float) -> float:
    """Time since the beginning, in 1/H0."""
    return adaptive(lambda x: 1.0 / (x * float(hubble_rate(c, np.array(x)))) if x > 0 else 0.0, 0.0, a)


def runge_kutta(rhs: Callable[[float, np.ndarray], np.ndarray], a: float, b: float, y: np.ndarray, steps: int) -> list[tuple[float, np.ndarray]]:
    """Fourth-order steps from a to b; all states."""
    h = (b - a) / steps
    out = [(a, y)]
    for s in range(steps):
        t = a + s * h
        k1 = rhs(t, y)
        k2 = rhs(t + h / 2, y + h / 2 * k1)
        k3 = rhs(t + h / 2, y + h / 2 * k2)
        k4 = rhs(t + h, y + h * k3)
        y = y + h / 6 * (k1 + 2 * k2 + 2 * k3 + k4)
        out.append((t + h, y))
    return out


# Nodes and weights of the fifth-order step of Cash and Karp and of the fourth-order step within it.
NODES = ((), (1 / 5,), (3 / 40, 9 / 40), (3 / 10, -9 / 10, 6 / 5), (-11 / 54, 5 / 2, -70 / 27, 35 / 27), (1631 / 55296, 175 / 512, 575 / 13824, 44275 / 110592, 253 / 4096))
FIFTH = (37 / 378, 0, 250 / 621, 125 / 594, 0, 512 / 1771)
FOURTH = (2825 / 27648, 0, 18575 / 48384, 13525 / 55296, 277 / 14336, 1 / 4)


def adaptive_steps(rhs: Callable[[float, np.ndarray], np.ndarray], a: float, b: float, y: np.ndarray, tolerance: float = 1e-8, first: float | None = None) -> list[tuple[float, np.ndarray]]:
    """Steps from a to b (a < b) whose error, by two orders, stays below the tolerance times the largest component; all states."""
    t, y, h = a, np.asarray(y, float), first or (b - a) / 100
    out = [(t, y)]
    while t < b:
        h = min(h, b - t)
        k: list[np.ndarray] = []
        for row in NODES:
            k.append(np.asarray(rhs(t + h * sum(row), y + h * sum((w * x for w, x in zip(row, k, strict=True)), np.zeros_like(y))), float))
        high = y + h * sum(w * x for w, x in zip(FIFTH, k, strict=True))
        low = y + h * sum(w * x for w, x in zip(FOURTH, k, strict=True))
        scale = max(np.abs(y).max(), np.abs(high).max(), 1e-300)
        error = float(np.abs(high - low).max() / (tolerance * scale))
        if error <= 1 or h <= 1e-14 * (b - a):
            t = b if h == b - t else t + h
            y = high
            out.append((t, y))
        h *= min(5.0, max(0.2, 0.9 * max(error, 1e-10) ** -0.2))
    return out


@dataclass(frozen=True)
class PowerTable:
    """A spectrum tabulated in equal steps of ln k, with slopes 1 below and -3 above the table."""

    k: tuple[float, ...]
    p: tuple[float, ...]

    def __call__(self, k: np.ndarray) -> np.ndarray:
        k = np.asarray(k, float)
        first, last = self.k[0], self.k[-1]
        inside = np.exp(np.interp(np.log(np.clip(k, first, last)), np.log(self.k), np.log(self.p)))
        return np.where(k < first, self.p[0] * (k / first), np.where(k > last, self.p[-1] * (k / last) ** -3.0, inside))


def top_hat(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    safe = np.maximum(x, 1e-3)
    return np.where(x < 1e-3, 1 - x * x / 10, 3 * (np.sin(safe) - safe * np.cos(safe)) / safe**3)


def sigma_radius(p: Callable, r: float) -> float:
    """The rms contrast in spheres of radius r."""
    f = lambda lnk: p(np.exp(lnk)) * np.exp(3 * lnk) * top_hat(np.exp(lnk) * r) ** 2 / (2 * np.pi**2)
    return integrate(f, np.log(1e-5), np.log(100.0 / r), 4000) ** 0.5


def mass_radius(c: Cosmology, mass: np.ndarray) -> np.ndarray:
    """The radius, in Mpc/h, that holds a mass in Msun/h at mean density."""
    return (np.asarray(mass) / (4 * np.pi / 3 * 2.774e11 * c.omega_m)) ** (1 / 3)


def sigma_mass(c: Cosmology, p: Callable, mass: float) -> float:
    return sigma_radius(p, float(mass_radius(c, np.array(mass))))


def log_slope(c: Cosmology, p: Callable, mass: float) -> float:
    """d ln sigma / d ln M by a difference of a tenth either way."""
    up, down = sigma_mass(c, p, 1.1 * mass), sigma_mass(c, p, 0.9 * mass)
    return float(np.log(up / down) / np.log(1.1 / 0.9))


def normalised(c: Cosmology, table: PowerTable) -> PowerTable:
    """The table scaled to the cosmology's sigma8."""
    f = (c.sigma8 / sigma_radius(table, 8.0)) ** 2
    return PowerTable(table.k, tuple(f * x for x in table.p))


def particle_mass(c: Cosmology, box: float, rows: int) -> float:
    return c.omega_m * 2.774e11 * (box / rows) ** 3


def scales(c: Cosmology, box: float, rows: int, grid: int, a: float) -> dict:
    """Units of a run of rows**3 particles on a mesh: mass of a particle, length and velocity of a cell, and the domain."""
    return {"particle_mass": particle_mass(c, box, rows), "length": box / grid, "velocity": 100.0 * box / grid / a, "domain": (0.0, box)}


def concentration_ratio(x: np.ndarray) -> np.ndarray:
    """(Vmax / Vvir)**2 of a profile with concentration x: 0.2162166 x / (ln(1 + x) - x / (1 + x))."""
    return 0.2162166 * x / (np.log1p(x) - x / (1 + x))


def concentration(v_ratio: np.ndarray) -> np.ndarray:
    """The concentration of a Vmax / Vvir ratio, by bisection above the profile's maximum; nan below a ratio of 1."""
    target = np.asarray(v_ratio, float) ** 2
    low, high = np.full(target.shape, 2.1626), np.full(target.shape, 1e4)
    for _ in range(80):
        mid = (low + high) / 2
        below = concentration_ratio(mid) < target
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return np.where(target >= 1, (low + high) / 2, np.nan)


def mass_at_overdensity(mass: np.ndarray, conc: np.ndarray, ratio: float) -> np.ndarray:
    """The mass within ratio times the overdensity at which mass and conc are given, for an NFW profile."""
    f = lambda x: np.log1p(x) - x / (1 + x)
    mass, conc = np.asarray(mass, float), np.asarray(conc, float)
    low, high = np.full(conc.shape, 1e-3), np.full(conc.shape, 1e3)
    for _ in range(100):  # f(x) / x**3 falls with x
        x = (low + high) / 2
        dense = f(x) / x**3 > ratio * f(conc) / conc**3
        low, high = np.where(dense, x, low), np.where(dense, high, x)
    return mass * f((low + high) / 2) / f(conc)
