"""Time steps: state goes from step to step as a DataFrame, cut from its lineage by a checkpoint after each.

A step deposits particles, solves for the potential, kicks by its gradient and drifts.  The driver holds the clock alone.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlark.functions.storage import cut
from meshlark.operators import mesh as M
from meshlark.operators import spectra as S
from meshlark.sources.text import PHASES
from meshlark.streaming import relax as X


@dataclass(frozen=True)
class Clock:
    a: float
    step: int = 0
    da: float = 0.01

    def advanced(self) -> Clock:
        return replace(self, a=self.a + self.da, step=self.step + 1)


def grown_step(a: float, da: float, limit: float, most: float = 0.3, growth: float = 1.5) -> float:
    """The next step of the scale factor: growth times it, while it is well below the limit and a is small."""
    return da * growth if da < limit / 1.25 * a and a < most else da


def schedule(a: float, da: float, limit: float, last: float = 1.0, most: float = 0.3) -> list[tuple[int, float, float]]:
    """(step, a, da) until a reaches last."""
    out = []
    step = 0
    while a < last:
        out.append((step, a, da))
        a, da, step = a + da, grown_step(a, da, limit, most), step + 1
    return out


#: Weights of the distances to the three redshifts, in order: a distance counts in these units.
UNITS = (0.02, 0.01, 3e-4)


def steps_of(a: np.ndarray, da: np.ndarray, redshifts: tuple[float, float, float], most: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
    """The number of steps to a over 1 of schedules that begin with a and da, and the distance of their steps to redshifts.

    A step grows by half while it is below its first share of a, less a fifth, and a is below a half.  All schedules
    advance at once.  A redshift that no two steps enclose is 1000 away.
    """
    a, da, limit = a.astype(float), da.astype(float), da / a
    n, away = np.zeros(len(a), np.int64), np.full((len(a), 3), 1e3)
    z = np.full(len(a), np.inf)
    live = np.arange(len(a))
    for _ in range(most):
        if not len(live):
            break
        grow = (da[live] < limit[live] / 1.25 * a[live]) & (a[live] < 0.5)
        da[live] = np.where(grow, 1.5 * da[live], da[live])
        a[live] += da[live]
        n[live] += 1
        before, z[live] = z[live], 1 / a[live] - 1
        for i, w in enumerate(redshifts):
            met = (n[live] > 1) & (before > w) & (z[live] <= w)
            away[live[met], i] = np.minimum(before[met] - w, w - z[live][met])
        live = live[a[live] <= 1]
    return n, away


def tune(grid: DataFrame, redshifts: tuple[float, float, float], count: int, width: int) -> DataFrame:
    """Of a grid (a, da) of starts and first steps the row with the least error: (a, da, steps, error).

    Error: the distances of the schedule's steps to three redshifts, each in its unit, and 10 exp(((steps - count) /
    width)**2).  Schedules of count +- width steps or more off are no candidates; nor are starts outside 0.005 to 0.02.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, da = (batch.column(i).to_numpy() for i in (0, 1))
            n, away = steps_of(a, da, redshifts)
            error = sum(away[:, i] / u for i, u in enumerate(UNITS)) + 10 * np.exp(np.minimum(((n - count) / width) ** 2, 700.0))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(da), pa.array(n), pa.array(error)], ["a", "da", "steps", "error"])

    tried = grid.where("a > 5e-3 AND a < 0.02 AND da > 1e-5 AND da < 0.02").select("a", "da").mapInArrow(run, "a double, da double, steps long, error double")
    tried = tried.where((F.col("steps") > count - width) & (F.col("steps") < count + width))
    return tried.agg(F.min(F.struct("error", "a", "da", "steps")).alias("best")).where("best IS NOT NULL").select("best.a", "best.da", "best.steps", "best.error")


def forces(points: DataFrame, potential: DataFrame, n: int) -> DataFrame:
    """points with fx, fy, fz: minus the potential's gradient at each."""
    out = M.at_points(points, M.gradient(potential, n), n, {f"f{a}": f"g{a}" for a in M.AXES})
    return out.withColumns({f"f{a}": -F.col(f"f{a}") for a in M.AXES})


def move(points: DataFrame, potential: DataFrame, n: int, kick: float, drift: float, friction: float = 1.0) -> DataFrame:
    """Leapfrog: velocities first, then positions, wrapped."""
    out = forces(points, potential, n)
    out = out.withColumns({f"v{a}": F.col(f"v{a}") * friction + kick * F.col(f"f{a}") for a in M.AXES})
    out = out.withColumns({a: M.wrap(F.col(a) + drift * F.col(f"v{a}"), n) for a in M.AXES})
    return out.drop(*[f"f{a}" for a in M.AXES])


def energies(points: DataFrame) -> DataFrame:
    v2 = F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy") + F.col("vz") * F.col("vz")
    return points.agg((F.sum(v2) / 2).alias("ekin"), F.count(F.lit(1)).alias("n"))


@dataclass(frozen=True)
class FifthForce:
    """A scalar field in the loop: its model, factor and power in the potential, and friction of velocities, by a."""

    model: Callable[[float], X.Model]
    factor: Callable[[float], float]
    power: int = 1
    kind: str = "V"
    friction: Callable[[float], float] = lambda a: 1.0


class Timing:
    """Minutes by phase of a step; a phase's result is written before the phase ends, so that it holds its own work."""

    def __init__(self):
        self.minutes = dict.fromkeys(PHASES, 0.0)

    @contextmanager
    def phase(self, name: str):
        began = time.perf_counter()
        try:
            yield
        finally:
            took = (time.perf_counter() - began) / 60
            self.minutes[name] += took
            self.minutes["total"] += took

    def line(self, step: int) -> str:
        """A line of a timing log; the next step begins from zero."""
        out = f"{step:5d}" + "".join(f"{self.minutes[p]:13.4f}" for p in PHASES)
        self.minutes = dict.fromkeys(PHASES, 0.0)
        return out


def step(points: DataFrame, n: int, clock: Clock, omega_m: float, fifth: FifthForce | None = None, timing: Timing | None = None) -> DataFrame:
    """One step, kept in the checkpoint folder: gravity, and a scalar field's force beside it if one is given."""
    timing = timing or Timing()
    with timing.phase("density"):
        density = cut(M.deposit(points, n))
    with timing.phase("force"):
        potential = cut(S.potential(density, n, 1.5 * omega_m / clock.a))
    friction = 1.0
    if fifth is not None:
        with timing.phase("field"):
            field = X.scalar_field(density, n, fifth.model(clock.a), fifth.kind)
            potential = cut(X.add_fifth_force(potential, field, fifth.factor(clock.a), fifth.power))
        friction = fifth.friction(clock.a)
    rate = (omega_m / clock.a**3 + 1 - omega_m) ** 0.5 * clock.a  # da / dt
    with timing.phase("move"):
        return cut(move(points, potential, n, clock.da / rate, clock.da / (rate * clock.a**2), friction))


def save(points: DataFrame, clock: Clock, path: str) -> None:
    """A state from which a run goes on: particles as Parquet, and beside them the clock, written last."""
    points.write.mode("overwrite").parquet(f"{path}/particles")
    points.sparkSession.createDataFrame([(clock.a, clock.step, clock.da)], "a double, step int, da double").write.mode("overwrite").parquet(f"{path}/clock")


def resume(spark: SparkSession, path: str) -> tuple[DataFrame, Clock]:
    a, at, da = spark.read.parquet(f"{path}/clock").first()
    return spark.read.parquet(f"{path}/particles"), Clock(a, at, da)


def run(points: DataFrame, n: int, clock: Clock, steps: int, omega_m: float, each=None, every: int = 0, fifth: FifthForce | None = None, log: list[str] | None = None) -> tuple[DataFrame, Clock]:
    """Steps from a state; each(points, clock) is called after every so many, to write or to measure.

    log gets a timing line a step.  A run that saved its state goes on from resume(path) as if it hadn't ended.
    """
    timing = Timing()
    for _ in range(steps):
        points, clock = step(points, n, clock, omega_m, fifth, timing), clock.advanced()
        if each is not None and every and clock.step % every == 0:
            with timing.phase("io"):
                each(points, clock)
        if log is not None:
            log.append(timing.line(clock.step))
    return points, clock


def analyse(points: DataFrame, n: int, box: float, power: bool = True, density: bool = True, peaks: float | None = None) -> dict[str, DataFrame]:
    """What the flags ask for, all from one mesh."""
    mesh = cut(M.deposit(points, n))
    out = {}
    if density:
        out["density"] = M.density_distribution(mesh)
    if power:
        out["power"] = S.power(S.transform(mesh, n), n, box)
    if peaks is not None:
        out["peaks"] = M.peaks(mesh, peaks, n)
    return out
