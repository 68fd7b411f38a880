"""Cycles over meshes of any size: levels as rows of blocks, each with layers of its neighbours while it is worked on.

A level is a DataFrame (b, rho, u, wanted, shift): a row a block of side**3 cells, arrays as bytes; wanted + shift is what
the operator should be.  Blocks send their margins to the 26 around them in one shuffle (`meet`), wide enough for all
half-sweeps of a step: after each the outermost layer is stale and isn't used, so the result is that of the whole mesh.
A step that works on blocks halves their side with the mesh; levels of up to WHOLE cells along an axis, a fixed bound,
are solved in one task.  The driver holds the order of steps alone; state is cut from its lineage after each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlark.functions.storage import cut
from meshlark.operators import mesh as M
from meshlark.streaming import relax as X

WHOLE = 64
MOST_SIDE = 96
AROUND = [(p, q, r) for p in (-1, 0, 1) for q in (-1, 0, 1) for r in (-1, 0, 1)]
STATE = "b long, rho binary, u binary, wanted binary, shift double"


@dataclass(frozen=True)
class Level:
    """n cells along an axis in blocks of side cells; dx is the cells' size in the finest ones."""

    n: int
    side: int
    dx: float = 1.0

    @property
    def blocks(self) -> int:
        return self.n // self.side

    def coarser(self) -> Level:
        return Level(self.n // 2, self.side // 2, 2 * self.dx)

    def origin(self, b: int) -> tuple[int, int, int]:
        return b // self.blocks**2 * self.side, b // self.blocks % self.blocks * self.side, b % self.blocks * self.side


def first_level(n: int, most: int = MOST_SIDE) -> Level:
    """Blocks whose side can be halved most often, and of these the largest up to most."""
    sides = [s for s in range(1, min(n, most) + 1) if n % s == 0]
    return Level(n, max(sides, key=lambda s: (s & -s, s)))


def array(raw: pa.Scalar | bytes, side: int) -> np.ndarray:
    return np.frombuffer(raw.as_py() if isinstance(raw, pa.Scalar) else raw, np.float64).reshape(side, side, side)


def pack(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x, np.float64).tobytes()


def meet(blocks: DataFrame, level: Level, arrays: dict[str, tuple[int, int]], scalars: tuple[str, ...], work: Callable, schema: str) -> DataFrame:
    """work(b, arrays, scalars) for each block, with margins; it gives a row of schema, or several.

    arrays: by column the side of its blocks and the width of the margin.  One shuffle, of blocks and their margins.
    """
    nb = level.blocks
    names = list(arrays)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                b = batch.column(0)[row].as_py()
                at = b // nb**2, b // nb % nb, b % nb
                out: dict[str, list] = {c: [] for c in ("b", "o", *names)}
                for o, step in enumerate(AROUND):  # the block at `at` lies at -step of the one it is sent to
                    to = [(x - s) % nb for x, s in zip(at, step, strict=True)]
                    out["b"].append((to[0] * nb + to[1]) * nb + to[2])
                    out["o"].append(o)
                    for i, name in enumerate(names):
                        side, width = arrays[name]
                        part = tuple(slice(0, width) if s == 1 else slice(side - width, side) if s == -1 else slice(None) for s in step)
                        out[name].append(pack(array(batch.column(1 + i)[row], side)[part]))
                kept = {c: pa.array([batch.column(1 + len(names) + i)[row].as_py()] * len(AROUND), pa.float64()) for i, c in enumerate(scalars)}
                columns = [pa.array(out["b"], pa.int64()), pa.array(out["o"], pa.int32()), *[pa.array(out[c], pa.binary()) for c in names], *kept.values()]
                yield pa.RecordBatch.from_arrays(columns, ["b", "o", *names, *scalars])

    def gather(rows: pa.Table) -> pa.Table:
        full = {}
        order = rows.column("o").to_pylist()
        for name in names:
            side, width = arrays[name]
            x = np.empty((side + 2 * width,) * 3)
            for o, raw in zip(order, rows.column(name).to_pylist(), strict=True):
                where = [(slice(side + width, side + 2 * width), width) if s == 1 else (slice(0, width), width) if s == -1 else (slice(width, width + side), side) for s in AROUND[o]]
                x[tuple(w for w, _ in where)] = np.frombuffer(raw, np.float64).reshape([k for _, k in where])
            full[name] = x
        own = {c: rows.column(c)[order.index(13)].as_py() for c in scalars}
        with np.errstate(all="ignore"):  # stale margins may be anything
            return pa.Table.from_pylist(work(rows.column("b")[0].as_py(), full, own), schema=arrow(schema))

    sent = blocks.select("b", *names, *scalars).mapInArrow(send, "b long, o int, " + ", ".join([*[f"{c} binary" for c in names], *[f"{c} double" for c in scalars]]))
    return sent.groupBy("b").applyInArrow(gather, schema)


def arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}
    return pa.schema([(c, kinds[k]) for c, k in (x.split() for x in schema.split(", "))])


def inner(x: np.ndarray, width: int) -> np.ndarray:
    return x[width:-width, width:-width, width:-width] if width else x


def of_mesh(mesh: DataFrame, level: Level, start: float) -> DataFrame:
    """The level of a dense mesh (i, j, k, val): rho is val, u is start, nothing is wanted."""
    s, nb = level.side, level.blocks
    block = F.lit(0).cast("long")
    for c in M.CELL:
        block = block * nb + F.floor((F.col(c) - 1) / s)

    def run(rows: pa.Table) -> pa.Table:
        i, j, k, v = (rows.column(c).to_numpy() for c in (*M.CELL, "val"))
        rho = np.zeros((s, s, s))
        rho[(i - 1) % s, (j - 1) % s, (k - 1) % s] = v
        row = {"b": rows.column("b")[0].as_py(), "rho": pack(rho), "u": pack(np.full_like(rho, start)), "wanted": pack(np.zeros_like(rho)), "shift": 0.0}
        return pa.Table.from_pylist([row], schema=arrow(STATE))

    return cut(mesh.select(block.alias("b"), *M.CELL, "val").groupBy("b").applyInArrow(run, STATE))


def sources(state: DataFrame, level: Level, model: X.Model) -> float:
    """The mean of the model's source over the level: of models whose source has its mean taken out."""
    s = level.side

    def work(b, x, _):
        return [{"total": float(inner(model.source(x["u"], x["rho"], level.dx), 1).sum())}]

    return meet(state, level, {"u": (s, 1), "rho": (s, 1)}, (), work, "total double").agg(F.sum("total")).first()[0] / level.n**3


def smooth(state: DataFrame, level: Level, model: X.Model, sweeps: int = 2) -> DataFrame:
    """Gauss-Seidel sweeps: all in one step, or a half-sweep a step if the model needs its source's mean in between."""
    halves = [0, 1] * sweeps
    most = 1 if model.balanced else level.side  # a margin comes from the next block alone
    for group in [halves[at : at + most] for at in range(0, len(halves), most)]:
        mean = sources(state, level, model) if model.balanced else None
        s, w = level.side, len(group)

        def work(b, x, own, group=group, mean=mean, w=w):
            u, wanted = x["u"], x["wanted"] + own["shift"]
            index = sum(np.ix_(*[np.arange(o - w, o + s + w) for o in level.origin(b)])) % 2
            for p in group:
                u = np.where(index == p, model.solved(u, x["rho"], wanted, level.dx, mean), u)
            return [{"b": b, "rho": pack(inner(x["rho"], w)), "u": pack(inner(u, w)), "wanted": pack(inner(x["wanted"], w)), "shift": own["shift"]}]

        state = cut(meet(state, level, {c: (s, w) for c in ("rho", "u", "wanted")}, ("shift",), work, STATE))
    return state


def coarsened(state: DataFrame, level: Level, model: X.Model) -> DataFrame:
    """The level below: fields restricted, and wanted L(R u) + R (wanted - L u)."""
    s = level.side

    def work(b, x, own):
        rest = x["wanted"] + own["shift"] - model.operator(x["u"], x["rho"], level.dx, 0.0)
        rho2, u2, r2 = (X.restricted(y) for y in (x["rho"], x["u"], rest))
        wanted = model.operator(u2, rho2, 2 * level.dx, 0.0) + r2
        return [{"b": b, "rho": pack(inner(rho2, 2)), "u": pack(inner(u2, 2)), "wanted": pack(inner(wanted, 2)), "shift": 0.0}]

    low = cut(meet(state, level, {c: (s, 4) for c in ("rho", "u", "wanted")}, ("shift",), work, STATE))
    if model.balanced:
        change = sources(low, level.coarser(), model) - sources(state, level, model)
        low = low.withColumn("shift", F.lit(change))
    return low


def corrected(state: DataFrame, level: Level, model: X.Model, before: DataFrame, after: DataFrame) -> DataFrame:
    """state with u moved by what the level below changed, trilinear; positive fields stay positive."""
    s, half = level.side, level.side // 2
    both = before.select("b", F.col("u").alias("before")).join(after.select("b", F.col("u").alias("after")), "b")

    def work(b, x, own):
        better = x["u"] + inner(X.prolonged(x["after"] - x["before"]), 2)
        if model.positive:
            better = np.where(better > 0, better, x["u"])
        return [{"b": b, "rho": pack(x["rho"]), "u": pack(better), "wanted": pack(x["wanted"]), "shift": own["shift"]}]

    return cut(meet(state.join(both, "b"), level, {"rho": (s, 0), "u": (s, 0), "wanted": (s, 0), "before": (half, 1), "after": (half, 1)}, ("shift",), work, STATE))


def in_one_task(state: DataFrame, level: Level, model: X.Model, kind: str) -> DataFrame:
    """A cycle over a level of WHOLE cells along an axis or fewer."""
    s, n = level.side, level.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rho, u, wanted = (np.zeros((n, n, n)) for _ in range(3))
        seen = []
        for batch in batches:
            for r in range(batch.num_rows):
                b = batch.column(0)[r].as_py()
                seen.append(b)
                at = tuple(slice(o, o + s) for o in level.origin(b))
                rho[at], u[at] = array(batch.column(1)[r], s), array(batch.column(2)[r], s)
                wanted[at] = array(batch.column(3)[r], s) + batch.column(4)[r].as_py()
        if seen:
            u = X.cycle(model, u, rho, wanted, level.dx, kind)
        for b in seen:
            at = tuple(slice(o, o + s) for o in level.origin(b))
            row = {"b": b, "rho": pack(rho[at]), "u": pack(u[at]), "wanted": pack(wanted[at]), "shift": 0.0}
            yield pa.RecordBatch.from_pylist([row], schema=arrow(STATE))

    return cut(state.repartition(1).mapInArrow(run, STATE))


def cycle(state: DataFrame, level: Level, model: X.Model, kind: str, whole: int = WHOLE) -> DataFrame:
    """One V, F or W cycle from this level down."""
    if level.n <= whole:
        return in_one_task(state, level, model, kind)
    if level.side % 2 or level.side < 8:  # no further level
        return smooth(state, level, model, 4)
    state = smooth(state, level, model)
    low = coarsened(state, level, model)
    after = low
    for k in {"V": "V", "F": "FV", "W": "WW"}[kind]:
        after = cycle(after, level.coarser(), model, k, whole)
    return smooth(corrected(state, level, model, low, after), level, model)


def residuals(state: DataFrame, level: Level, model: X.Model) -> DataFrame:
    """(b, u, residual) of the finest level."""
    s = level.side
    mean = sources(state, level, model) if model.balanced else None

    def work(b, x, _):
        return [{"b": b, "u": pack(inner(x["u"], 1)), "residual": pack(inner(model.operator(x["u"], x["rho"], level.dx, mean), 1))}]

    return cut(meet(state, level, {"u": (s, 1), "rho": (s, 1)}, (), work, "b long, u binary, residual binary"))


def rms(found: DataFrame, level: Level) -> float:
    """The rms residual: a number a block comes to the driver's sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = [float(np.square(array(x, level.side)).sum()) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(total, pa.float64())], ["total"])

    return (found.select("residual").mapInArrow(run, "total double").agg(F.sum("total")).first()[0] / level.n**3) ** 0.5


def to_mesh(found: DataFrame, level: Level) -> DataFrame:
    """(i, j, k, val, residual) of blocks (b, u, residual)."""
    s = level.side

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                at = [pa.array((x.ravel() + o + 1).astype(np.int32)) for x, o in zip(np.indices((s, s, s)), level.origin(batch.column(0)[r].as_py()), strict=True)]
                yield pa.RecordBatch.from_arrays([*at, pa.array(array(batch.column(1)[r], s).ravel()), pa.array(array(batch.column(2)[r], s).ravel())], ["i", "j", "k", "val", "residual"])

    return found.mapInArrow(run, "i int, j int, k int, val double, residual double")


def restricted_residual(state: DataFrame, level: Level, model: X.Model) -> DataFrame:
    """(i, j, k, residual, wanted) of the level below: R (wanted - L u), and with L(R u) added what is wanted there."""
    s = level.side

    def work(b, x, own):
        rest = x["wanted"] + own["shift"] - model.operator(x["u"], x["rho"], level.dx, 0.0)
        return [{"b": b, "residual": pack(inner(X.restricted(rest), 1))}]

    rest = meet(state, level, {c: (s, 2) for c in ("rho", "u", "wanted")}, ("shift",), work, "b long, residual binary")
    both = coarsened(state, level, model).select("b", F.col("wanted").alias("u")).join(rest, "b").select("b", "u", "residual")
    return to_mesh(both, level.coarser()).select("i", "j", "k", "residual", F.col("val").alias("wanted"))


def solve(mesh: DataFrame, n: int, model: X.Model, kind: str = "V", most: int = 12, enough: float = 1e-9, level: Level | None = None, whole: int = WHOLE) -> tuple[DataFrame, list[float]]:
    """(i, j, k, val, residual) of a dense mesh (i, j, k, val), and the rms residual after each cycle.

    Cycles end when the residual is small enough or stalls, as those of a mesh in one task.
    """
    level = level or first_level(n)
    state = of_mesh(mesh, level, model.start())
    told: list[float] = []
    for k in range(most):
        state = cycle(state, level, model, kind, whole)
        found = residuals(state, level, model)
        told.append(rms(found, level))
        if X.settled(told, k, enough):
            break
    return to_mesh(found, level), told
