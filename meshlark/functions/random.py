"""Random numbers by a key: a stateless hash for Columns, and Philox streams for arrays.

A sequential generator would tie results to the order of rows; these depend on the row's key and the seed alone.  The
generator of older runs is there, too, by its place in the sequence: a congruence, of which any step can be reached at once.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from meshlark.operators.mesh import hash01
from meshlark.operators.spectra import normal

__all__ = ["gaussian", "hash01", "normal", "seed_table", "seeds", "sequential", "sequential_normal", "sequential_state", "uniform"]


def uniform(seed: int, stream: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.Philox(key=[seed, stream])).random(n)


def gaussian(seed: int, stream: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.Philox(key=[seed, stream])).standard_normal(n)


# Multiplier, increment and modulus of the sequential generator.
MULTIPLIER, INCREMENT, MODULUS = 8405125, 453815927, 1 << 31


def _jump(n: int) -> tuple[int, int]:
    """(a, c) of n steps of the sequential generator: the state s becomes a s + c."""
    a, c, at, by = 1, 0, MULTIPLIER, INCREMENT
    while n:
        if n & 1:
            a, c = at * a % MODULUS, (at * c + by) % MODULUS
        at, by = at * at % MODULUS, (at * by + by) % MODULUS
        n >>= 1
    return a, c


def sequential_state(seed: int, n: Column, bits: int = 40) -> Column:
    """The state after n steps from a seed: a row jumps to its own place, whatever rows come before it."""
    jumps = F.array(*[F.struct(F.lit(1 << b).cast("long").alias("p"), F.lit(a).cast("long").alias("a"), F.lit(c).cast("long").alias("c")) for b in range(bits) for a, c in [_jump(1 << b)]])
    step = lambda s, j: F.when(F.floor(n / j["p"]) % 2 == 1, F.pmod(s * j["a"] + j["c"], F.lit(MODULUS))).otherwise(s)
    return F.aggregate(jumps, F.lit(seed % MODULUS).cast("long"), step)


def sequential(seed: int, n: Column) -> Column:
    """The n-th number in [0, 1) of the sequential generator."""
    return sequential_state(seed, n) / F.lit(float(MODULUS))


def sequential_normal(seed: int, n: Column) -> Column:
    """The n-th nearly normal number: from the sum of five numbers, with a correction of its tails."""
    x = sum((sequential(seed, 5 * n - 4 + i) for i in range(5)), F.lit(0.0))
    x = 1.5491933 * (x - 2.5)
    return x * (1.0 - 0.01 * (3.0 - x * x))


def seed_table(n: int, seed: int = 1298302, slip: int = 137, apart: int = 2357) -> list[int]:
    """n seeds of the sequential generator, each apart from the one before by `apart` numbers and up to slip more."""
    out = []
    for _ in range(n):
        a, c = _jump(1)
        seed = (a * seed + c) % MODULUS
        more = int(np.float32(seed) / np.float32(MODULUS) * np.float32(slip)) + 1
        a, c = _jump(apart + more)
        seed = (a * seed + c) % MODULUS
        out.append(seed)
    return out


def seeds(seed: int, n: int) -> list[int]:
    """A table of n seeds from one, for realizations or planes of a mesh."""
    return [int(x) for x in np.random.SeedSequence(seed).generate_state(n)]
