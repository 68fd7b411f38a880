"""LM scoring by a hierarchical Pitman-Yor model of words, seated by Gibbs sampling.

Restaurants: one for each context (the word before, hashed into CONTEXTS classes), all with one parent, the restaurant of
single words, whose base is uniform over the known words and one unknown word.  A customer of the parent is a table of a
context restaurant.  A sweep redraws the number of tables of every (context, word) cell from its full conditional, given
the other cells of the sweep before (the usual approximation of parallel samplers), and then those of the parent.  A
text's score is the log10 probability of its words and end, with predictive probabilities averaged over SAMPLES sweeps.

Discounts are estimated for each level from its cells of one and of two customers.

  cells of one customer have one table; cells of up to EXACT customers are drawn from the exact conditional, by
  generalised Stirling numbers; larger ones from the balance of tables that open and close, which approaches it.

Distribution: all cells of a word lie in one shard, by the word's hash.  Counts are gathered before they are shuffled,
as sorted and compressed arrays, and so are the requests of the texts to be scored: distinct (word, context, text)
triples.  Shards exchange only totals by context, vectors of CONTEXTS numbers, whatever the corpus' size.  A shard whose
words have more than its share of the corpus is scored by several tasks.  The number of shards follows the input's.

Cases: a null or empty text is its end alone.  Null ids and repeated rows are scored each; an id that is null is learned
from as the id ''.  Ids may be of any type that has a text.  A word's hash of 64 bits stands for it.  Very long texts are whole, though their tokens are held
together with those of the texts around them.  Columns that clash with outputs are replaced.  Empty tables stay empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlark.llm._common import input_partitions, materialize, mix, scan_words, table, utf8

CONTEXT_BITS = 20
CONTEXTS = 1 << CONTEXT_BITS
END = np.uint64(0x5851F42D4C957F2D)
SWEEPS, SAMPLES = 4, 2
EXACT = 96
#: Numbers of tables that are listed for larger cells whose mode is well below.
LISTED = 64
STRENGTH = 1.0
#: Tokens that a task holds before it passes them on.
HELD = 2 << 20
SLICES = 64
#: The kind of rows that ask, behind the model (0) and its states (1 and on).
REQUEST = 1 << 20
#: Bytes of a shard's counts beyond which they are merged: a word has CONTEXTS cells at most, however often it occurs.
FOLDED = 32 << 20


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed binary."""
    head = ";".join(f"{a.dtype.str},{len(a)}" for a in arrays).encode()
    return len(head).to_bytes(4, "little") + head + zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def unpack(blob: bytes) -> list[np.ndarray]:
    n = int.from_bytes(blob[:4], "little")
    raw = zstandard.ZstdDecompressor().decompress(blob[4 + n :])
    out, at = [], 0
    for part in blob[4 : 4 + n].decode().split(";"):
        kind, size = part.split(",")
        kind = np.dtype(kind)
        out.append(np.frombuffer(raw, kind, int(size), at))
        at += kind.itemsize * int(size)
    return out


def small(x: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the narrowest type that holds them."""
    top = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def tokens_of(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Blocks of texts: word hashes (each text's end included), their contexts, their rows, and the number of rows."""
    raw, starts = utf8(column)
    first, n = 0, len(column)
    while first < n:
        last = max(int(np.searchsorted(starts, starts[first] + (1 << 20), side="right")) - 1, first + 1)
        w = scan_words(raw[starts[first] : starts[last]], starts[first : last + 1] - starts[first], lower=True)
        rows = last - first
        ends = w.doc_start[1:] + np.arange(rows)
        word = np.full(len(w.hash) + rows, END)
        inner = np.ones(len(word), bool)
        inner[ends] = False
        word[inner] = w.hash
        doc = np.repeat(np.arange(rows), np.diff(w.doc_start) + 1)
        before = np.empty_like(word)
        before[1:] = word[:-1]
        before[np.concatenate([[0], ends[:-1] + 1])] = END  # a text's first word follows an end
        yield word, (mix(before) >> np.uint64(64 - CONTEXT_BITS)).astype(np.int64), doc, rows
        first = last


def shard_of(word: np.ndarray, shards: int) -> np.ndarray:
    """The shard of sorted words; it never falls."""
    return ((word >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def ranked(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words in order, and the place of each word in them."""
    code, distinct = pd.factorize(word)
    order = np.argsort(distinct)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return distinct[order], place[code]


def runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of sorted keys, and how often each occurs."""
    if not len(sorted_keys):
        return sorted_keys, np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))
    return sorted_keys[at], np.diff(np.append(at, len(sorted_keys)))


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of the values of each."""
    order = np.argsort(keys)
    keys, values = keys[order], values[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(values, at) if len(at) else values


def parted(distinct: np.ndarray, shards: int) -> Iterator[tuple[int, int, int]]:
    """(shard, first, last) of the words of each shard that has some."""
    bound = np.searchsorted(shard_of(distinct, shards), np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(bound)):
        yield int(s), int(bound[s]), int(bound[s + 1])


# ---- counts -----------------------------------------------------------------------------------------------------------


def gather_counts(docs: DataFrame, shards: int) -> DataFrame:
    """(shard, blob) of docs (text, learned): cells of the texts to learn from, counted within each task."""

    def emit(word: list, context: list) -> Iterator[pa.RecordBatch]:
        distinct, place = ranked(np.concatenate(word))
        key, n = runs(np.sort(place << CONTEXT_BITS | np.concatenate(context)))
        cell = key >> CONTEXT_BITS
        found: tuple[list, list] = ([], [])
        for s, a, z in parted(distinct, shards):
            i, j = np.searchsorted(cell, [a, z])
            u = key[i:j] & (CONTEXTS - 1)
            found[0].append(s)
            found[1].append(pack(distinct[a:z], small(np.bincount(cell[i:j] - a, minlength=z - a)), (u & 0xFFFF).astype(np.uint16), (u >> 16).astype(np.uint8), small(n[i:j])))
        yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.binary())], ["shard", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word: list = []
        context: list = []
        for batch in batches:
            learned = batch.column(1).to_numpy(zero_copy_only=False)
            at = 0
            for w, u, doc, n in tokens_of(batch.column(0)):
                own = learned[at : at + n][doc]
                word.append(w[own])
                context.append(u[own])
                at += n
                if sum(map(len, word)) >= HELD:
                    yield from emit(word, context)
                    word, context = [], []
        if word:
            yield from emit(word, context)

    return docs.select("text", "learned").mapInArrow(run, "shard long, blob binary")


def cells_of(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words, and the word's place, context and customers of each cell, in order."""
    words, contexts, counts = [], [], []
    for blob in blobs:
        w, per, low, high, n = unpack(blob)
        words.append(np.repeat(w, per))
        contexts.append(low.astype(np.int64) | high.astype(np.int64) << 16)
        counts.append(n.astype(np.int64))
    distinct, place = ranked(np.concatenate(words))
    del words
    place <<= CONTEXT_BITS
    place |= np.concatenate(contexts)
    del contexts
    key, n = summed(place, np.concatenate(counts))
    return distinct, key >> CONTEXT_BITS, key & (CONTEXTS - 1), n


def slices(name: str, *vectors: np.ndarray) -> Iterator[tuple[str, int, bytes]]:
    """Vectors by context, in SLICES rows."""
    size = CONTEXTS // SLICES
    for i in range(SLICES):
        part = [v[i * size : (i + 1) * size] for v in vectors]
        if any(p.any() for p in part):
            yield name, i, pack(*map(small, part))


def total_slices(rows: DataFrame, width: int) -> np.ndarray:
    """width x CONTEXTS: the sum of all slices (shard, blob); the driver gets CONTEXTS numbers a vector."""
    size = CONTEXTS // SLICES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[i] = held.get(i, 0) + np.stack(unpack(blob)).astype(np.int64)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([pack(*x) for x in held.values()], pa.binary())], ["shard", "blob"])

    out = np.zeros((width, CONTEXTS), np.int64)
    for i, blob in rows.repartition(16, "shard").mapInArrow(run, "shard long, blob binary").collect():
        out[:, i * size : (i + 1) * size] = np.stack(unpack(blob))
    return out


def build(counts: DataFrame, shards: int) -> DataFrame:
    """(kind, shard, blob): by shard its model, the state of its cells and numbers; by slice, totals by context.

    model: words, their customers c, cells by word, contexts, whether a cell has more than one customer.
    state: by word, cells of one customer; of the other cells the word's place, context, customers and tables (one).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        customers, singles = np.zeros(CONTEXTS, np.int64), np.zeros(CONTEXTS, np.int64)
        for shard, blobs in by_group(batches, 0, 1, lambda own: count_blob(*cells_of(own))):
            word, place, context, n = cells_of(blobs)
            many = n > 1
            total = np.bincount(place, weights=n, minlength=len(word)).astype(np.int64)
            once = np.bincount(place[~many], minlength=len(word))
            customers += np.bincount(context, weights=n, minlength=CONTEXTS).astype(np.int64)
            singles += np.bincount(context[~many], minlength=CONTEXTS)
            per = np.bincount(place, minlength=len(word))
            model = pack(word, small(total), small(per), (context & 0xFFFF).astype(np.uint16), (context >> 16).astype(np.uint8), np.packbits(many))
            state = pack(small(once), place[many].astype(np.uint32), context[many].astype(np.uint32), small(n[many]), np.ones(int(many.sum()), np.uint8), np.zeros(0))
            numbers = pack(np.array([total.sum(), len(word), (n == 1).sum(), (n == 2).sum(), len(n), (per == 1).sum(), (per == 2).sum()], np.int64))
            yield rows_of([("model", shard, model), ("state", shard, state), ("numbers", shard, numbers)])
        yield rows_of(list(slices("contexts", customers, singles)))

    spread = counts.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard")
    return spread.mapInArrow(run, "kind string, shard long, blob binary")


def count_blob(word: np.ndarray, place: np.ndarray, context: np.ndarray, n: np.ndarray) -> bytes:
    """Counted cells, in order of word and context, as gather_counts packs them."""
    per = np.bincount(place, minlength=len(word))
    return pack(word, small(per), (context & 0xFFFF).astype(np.uint16), (context >> 16).astype(np.uint8), small(n))


def by_group(batches: Iterator[pa.RecordBatch], key: int, value: int, fold: Callable | None = None) -> Iterator[tuple[int, list]]:
    """The values of each run of a key; with fold, values of over FOLDED bytes are made one before more are held."""
    held: list = []
    now = None
    size = 0
    for batch in batches:
        for k, v in zip(batch.column(key).to_pylist(), batch.column(value).to_pylist(), strict=True):
            if k != now and held:
                yield now, held
                held, size = [], 0
            now = k
            held.append(v)
            if fold is not None:
                size += len(v)
                if size > FOLDED and len(held) > 1:
                    held = [fold(held)]
                    size = min(len(held[0]), FOLDED // 2)  # so that folding's cost stays a share of what is read
    if held:
        yield now, held


def rows_of(rows: list[tuple[str, int, bytes]]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["kind", "shard", "blob"])


# ---- seating ----------------------------------------------------------------------------------------------------------


def log_stirling(discount: float, most: int) -> np.ndarray:
    """log of the generalised Stirling numbers S(c, t), 1 <= t <= c <= most; -inf elsewhere."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0.0
    t = np.arange(most + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in range(most):
            stay = out[c] + np.log(np.maximum(c - discount * t, 0.0))
            opened = np.concatenate([[-np.inf], out[c, :-1]])
            out[c + 1] = np.logaddexp(np.where(np.isnan(stay), -np.inf, stay), opened)
    return out


def single_rate(discount: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean table size, and the share of tables with one customer, of a Gibbs partition: to interpolate."""
    z = 1 - np.logspace(-12, np.log10(1 - 1e-6), 400)[::-1]
    q = 1 - (1 - z) ** discount
    return z * discount * (1 - z) ** (discount - 1) / q, discount * z / q


def draw_tables(n: np.ndarray, base: np.ndarray | Callable, others: np.ndarray, discount: float, strength: float, random: np.random.Generator) -> np.ndarray:
    """Tables of cells of n customers: base is the parent's probability, others the restaurant's tables elsewhere.

    base: a number a cell, or a function of cells and of t (a column a number) that tells the probability of table t + 1
    when t have been sent to the parent, where each makes the next one likelier.
    """
    chance = base if callable(base) else lambda own, t: np.broadcast_to(base[own][:, None], np.broadcast_shapes((len(own), 1), np.shape(t)))
    out = np.minimum(n, 1).astype(np.int64)
    stirling = log_stirling(discount, EXACT)
    order = np.argsort(n, kind="stable")
    bound = np.searchsorted(n[order], np.arange(2, EXACT + 2))
    for c in range(2, EXACT + 1):
        cells = order[bound[c - 2] : bound[c - 1]]
        for at in range(0, len(cells), max((1 << 19) // c, 1)):
            own = cells[at : at + max((1 << 19) // c, 1)]
            more = np.log(strength + discount * (others[own][:, None] + np.arange(c)[None, :]))
            weight = stirling[c, 1 : c + 1] + np.cumsum(more + np.log(chance(own, np.arange(c)[None, :])), axis=1)
            out[own] = 1 + np.argmax(weight + random.gumbel(size=weight.shape), axis=1)
    large = order[bound[EXACT - 1] :]
    for at in range(0, len(large), 1 << 13):
        own = large[at : at + (1 << 13)]
        out[own] = _draw_large(n[own].astype(np.float64), lambda sub, t, own=own: chance(own[sub], t), others[own], discount, strength, random)
    return out


def _draw_large(c: np.ndarray, chance: Callable, others: np.ndarray, discount: float, strength: float, random: np.random.Generator) -> np.ndarray:
    """Tables of cells too large for exact conditionals, from the balance of tables that open and close.

    A customer is alone at its table with probability about q(c / t) (t - 1) / (c - 1), q being the share of tables with
    one customer among tables of that mean size; this gives the ratio of the probabilities of t + 1 and t tables.
    """
    mean, share = single_rate(discount)
    log_mean = np.log(mean)

    def alone(t: np.ndarray, own=slice(None)) -> np.ndarray:
        return np.interp(np.log(c[own, None] / t), log_mean, share) * (t - 1) / (c[own, None] - 1)

    def log_ratio(t: np.ndarray, own=slice(None)) -> np.ndarray:
        opens = (strength + discount * (others[own, None] + t)) * chance(own, t)
        closes = np.maximum(alone(t + 1, own) * (c[own, None] - 1 - discount * t), 1e-300)
        return np.log(np.maximum(1 - alone(t, own), 1e-300) * opens) - np.log(closes)

    low, high = np.ones((len(c), 1)), c[:, None] - 1
    for _ in range(40):
        t = (low + high) / 2
        rising = log_ratio(t) > 0
        low, high = np.where(rising, t, low), np.where(rising, high, t)
    mode = low[:, 0]
    out = np.empty(len(c))
    few = np.flatnonzero(mode < LISTED / 3)
    steps = np.arange(1, LISTED)[None, :].astype(float)
    weight = np.concatenate([np.zeros((len(few), 1)), np.cumsum(log_ratio(steps, few), axis=1)], axis=1)
    out[few] = 1 + np.argmax(weight + random.gumbel(size=weight.shape), axis=1)
    many = np.flatnonzero(mode >= LISTED / 3)
    step = np.maximum(mode[many, None] * 0.05, 1.0)
    slope = (log_ratio(np.minimum(mode[many, None] + step, c[many, None] - 1), many) - log_ratio(mode[many, None] - step, many)) / (2 * step)
    spread = np.sqrt(1 / np.maximum(-slope[:, 0], 1e-12))
    out[many] = mode[many] + spread * random.standard_normal(len(many))
    return np.clip(np.rint(out), 1, c).astype(np.int64)


class Totals:
    """What shards know of each other: by context, customers and tables; of the parent, customers, tables, base."""

    def __init__(self, customers, tables, root_customers, root_tables, size, discounts):
        self.customers, self.tables, self.root_customers, self.root_tables, self.size, self.discounts = customers, tables, root_customers, root_tables, size, discounts

    def __getstate__(self) -> dict:
        """Vectors travel compressed, as executors keep each broadcast on their disks."""
        return self.__dict__ | {"customers": None, "tables": None, "vectors": pack(small(self.customers), small(self.tables))}

    def __setstate__(self, state: dict) -> None:
        vectors = state.pop("vectors")
        self.__dict__ = state
        self.customers, self.tables = (v.astype(np.int64) for v in unpack(vectors))

    def next_table(self, customers: np.ndarray, tables: np.ndarray, fewer: np.ndarray) -> Callable:
        """The parent's probability of a cell's table t + 1, after the cell's `fewer` tables left and t came back."""
        d = self.discounts[1]
        stay = np.maximum(customers - fewer, 0)
        held, rest = np.minimum(tables, stay), np.maximum(self.root_customers - fewer, 0)
        fresh = (STRENGTH + d * self.root_tables) / (self.size + 1)

        def chance(own, t):
            here = stay[own][:, None] + t
            seats = np.maximum(here - d * np.maximum(held[own][:, None], np.minimum(here, 1)), 0.0)
            return (seats + fresh) / (STRENGTH + rest[own][:, None] + t)

        return chance

    def root(self, customers: np.ndarray, tables: np.ndarray, fewer: np.ndarray | int = 0) -> np.ndarray:
        """The parent's probability of words with these customers and tables, of which some customers left."""
        d = self.discounts[1]
        stay = np.maximum(customers - fewer, 0)
        seats = np.maximum(stay - d * np.minimum(tables, stay), 0.0)
        return (seats + (STRENGTH + d * self.root_tables) / (self.size + 1)) / (STRENGTH + np.maximum(self.root_customers - fewer, 0))


def sweep(state: DataFrame, totals: Totals, seed: int) -> DataFrame:
    """(kind, shard, blob): the state after a sweep, the parent's numbers by shard, tables by context in slices."""
    shared = state.sparkSession.sparkContext.broadcast(totals)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = shared.value
        tables = np.zeros(CONTEXTS, np.int64)
        for shard, blobs in by_group(batches, 0, 1):
            random = np.random.Generator(np.random.Philox(key=[seed, shard]))
            once, place, context, n, t, root = unpack(blobs[0])
            once, n, t = once.astype(np.int64), n.astype(np.int64), t.astype(np.int64)
            in_root = once + np.bincount(place, weights=t, minlength=len(once)).astype(np.int64)
            root = root.astype(np.int64) if len(root) else np.minimum(in_root, 1)
            base = now.next_table(in_root[place], root[place], t)
            t = draw_tables(n, base, np.maximum(now.tables[context] - t, 0), now.discounts[0], STRENGTH, random)
            in_root = once + np.bincount(place, weights=t, minlength=len(once)).astype(np.int64)
            flat = np.full(len(once), 1.0 / (now.size + 1))
            root = draw_tables(in_root, flat, np.maximum(now.root_tables - root, 0), now.discounts[1], STRENGTH, random)
            tables += np.bincount(context, weights=t, minlength=CONTEXTS).astype(np.int64)
            blob = pack(small(once), place, context, small(n), small(t), small(root))
            yield rows_of([("state", shard, blob), ("numbers", shard, pack(np.array([in_root.sum(), root.sum()], np.int64)))])
        yield rows_of(list(slices("contexts", tables)))

    return state.mapInArrow(run, "kind string, shard long, blob binary")


def _sum_numbers(rows: DataFrame) -> list[int]:
    found = [unpack(r["blob"])[0] for r in rows.where("kind = 'numbers'").select("blob").toLocalIterator()]  # a row a shard
    return [int(x) for x in np.sum(found, axis=0)] if found else []


def _discount(one: int, two: int) -> float:
    """From the numbers of cells of one and of two customers."""
    return min(max(one / (one + 2 * two), 0.1), 0.95) if one else 0.5


class Model:
    """A fitted model: tables of (shard, blob) and the totals of each sample."""

    def __init__(self, model: DataFrame, states: list[DataFrame], totals: list[Totals], numbers: list[int], shards: int, load: np.ndarray):
        self.model, self.states, self.totals, self.numbers, self.shards, self.load = model, states, totals, numbers, shards, load


def fit(docs: DataFrame, shards: int, sweeps: int = SWEEPS, samples: int = SAMPLES, seed: int = 1) -> Model:
    """docs: (text, learned)."""
    built = materialize(build(gather_counts(docs, shards), shards))
    of = lambda df, kind: df.where(F.col("kind") == kind).select("shard", "blob")
    numbers = _sum_numbers(built) or [0] * 7
    load = np.zeros(shards, np.int64)
    for r in of(built, "numbers").toLocalIterator():
        load[r["shard"]] = unpack(r["blob"])[0][0]
    customers, singles = total_slices(of(built, "contexts"), 2)
    discounts = _discount(numbers[2], numbers[3]), _discount(numbers[5], numbers[6])  # of contexts, by their cells; of the parent, by words' cells
    totals = Totals(customers, singles + np.maximum((customers - singles) // 4, 0), max(numbers[4], 1), max(numbers[1], 1), numbers[1], discounts)
    state = of(built, "state")
    states, held = [], []
    for k in range(sweeps):
        after = materialize(sweep(state, totals, seed * 1000 + k))
        root = _sum_numbers(after) or [0, 0]
        totals = Totals(customers, singles + total_slices(of(after, "contexts"), 1)[0], root[0], root[1], numbers[1], discounts)
        state = of(after, "state")
        if k >= sweeps - samples:
            states.append(state)
            held.append(totals)
    return Model(of(built, "model"), states, held, numbers, shards, load)


# ---- scoring ----------------------------------------------------------------------------------------------------------


def requests(docs: DataFrame, shards: int, slots: list[list[int]], key: str) -> DataFrame:
    """(slot, kind, flush, blob) of docs (key long, text, held): distinct (word, context, text) triples by shard."""

    def emit(held: list, ids: list, flush: int) -> Iterator[pa.RecordBatch]:
        word, context, doc = (np.concatenate([h[i] for h in held]) for i in range(3))
        distinct, place = ranked(word)
        n_docs = int(doc[-1]) + 1
        bits = max(n_docs - 1, 1).bit_length()
        triple, times = runs(np.sort(((place << CONTEXT_BITS | context) << bits) | doc))
        cell, per_cell = runs(triple >> bits)
        start = np.concatenate([[0], np.cumsum(per_cell)])
        names = pa.concat_arrays([i[0] for i in ids])
        null = names.is_null().to_numpy(zero_copy_only=False)
        key = names.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flags = null.astype(np.uint8) | np.concatenate([i[1] for i in ids]).astype(np.uint8) << 1
        of_word = cell >> CONTEXT_BITS
        found: tuple[list, list] = ([], [])
        for s, a, z in parted(distinct, shards):
            i, j = np.searchsorted(of_word, [a, z])
            u = cell[i:j] & (CONTEXTS - 1)
            p, q = start[i], start[j]
            some = triple[p:q] & ((1 << bits) - 1)
            blob = pack(np.diff(key, prepend=0), flags, distinct[a:z], small(np.bincount(of_word[i:j] - a, minlength=z - a)), (u & 0xFFFF).astype(np.uint16), (u >> 16).astype(np.uint8), small(per_cell[i:j]), small(some), small(times[p:q]))
            found[0].append(slots[s][flush % len(slots[s])])
            found[1].append(blob)
        n = len(found[0])
        yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array([REQUEST] * n, pa.int32()), pa.array([flush] * n, pa.int64()), pa.array(found[1], pa.binary())], ["slot", "kind", "flush", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        flush = TaskContext.get().partitionId() << 24
        held: list = []
        ids: list = []
        n_docs = 0
        for batch in batches:
            at = 0
            for word, context, doc, n in tokens_of(batch.column(1)):
                held.append((word, context, doc + n_docs))
                ids.append((batch.column(0).slice(at, n), batch.column(2).slice(at, n).to_numpy(zero_copy_only=False)))
                at, n_docs = at + n, n_docs + n
                if sum(len(h[0]) for h in held) >= HELD:
                    yield from emit(held, ids, flush)
                    held, ids, n_docs, flush = [], [], 0, flush + 1
        if held:
            yield from emit(held, ids, flush)

    return docs.select(key, "text", "held").mapInArrow(run, "slot long, kind int, flush long, blob binary")


def score(docs: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """(key, held_out, n_tokens, n_known, base_score, score) of docs (key long, text, held)."""
    share = max(int(model.load.sum()) // max(model.shards, 1), 1)
    slots: list[list[int]] = []
    n_slots = 0
    for load in model.load:  # a shard with much of the corpus gets several slots
        n = max(-(-int(load) // (2 * share)), 1)
        slots.append(list(range(n_slots, n_slots + n)))
        n_slots += n
    context = docs.sparkSession.sparkContext
    where = docs.sparkSession.createDataFrame([(s, x) for s, xs in enumerate(slots) for x in xs], "shard long, slot long")
    shared = context.broadcast(model.totals)
    n_train, n_words = model.numbers[0], model.numbers[1]
    parts = [(0, model.model), *enumerate(model.states, 1)]
    wanted = requests(docs, model.shards, slots, key)
    for kind, part in parts:
        rows = part.join(F.broadcast(where), "shard").select("slot", F.lit(kind).alias("kind"), F.lit(-1).cast("long").alias("flush"), "blob")
        wanted = wanted.unionByName(rows)
    wanted = wanted.repartitionById(n_slots, F.col("slot").cast("int")).sortWithinPartitions("slot", "kind", "flush")

    def answers(known: dict, blob: bytes) -> tuple:
        delta, flags, word, per, low, high, per_cell, doc, times = unpack(blob)
        n_docs = len(delta)
        if known:
            at = np.searchsorted(known["word"], word)
            at = np.minimum(at, len(known["word"]) - 1)
            here = known["word"][at] == word
        else:
            at, here = np.zeros(len(word), np.int64), np.zeros(len(word), bool)
        context = low.astype(np.int64) | high.astype(np.int64) << 16
        row = np.repeat(np.arange(len(word)), per)
        chance = np.zeros(len(row))
        if known:
            key = at[row] << CONTEXT_BITS | context
            cell = np.minimum(np.searchsorted(known["key"], key), len(known["key"]) - 1)
            hit = here[row] & (known["key"][cell] == key)
        for k, t in enumerate(shared.value):
            none = t.root(np.zeros(1), np.zeros(1))[0]
            root = np.where(here, known["root"][k][at], none) if known else np.full(len(word), none)
            p = (STRENGTH + t.discounts[0] * t.tables[context]) * root[row]
            if known:
                p[hit] += known["seats"][k][cell[hit]]
            chance += p / (STRENGTH + t.customers[context])
        log10 = np.log10(chance / len(shared.value))
        seen = np.where(here, known["total"][at], 0) if known else np.zeros(len(word))
        base = np.log10((seen + 0.1) / (n_train + 0.1 * (n_words + 1)))
        entry = np.repeat(np.arange(len(row)), per_cell)
        times = times.astype(np.float64)
        sums = [np.bincount(doc, weights=times * x, minlength=n_docs) for x in (log10[entry], base[row][entry], (seen > 0)[row][entry])]
        return np.cumsum(delta), flags, sums[0], sums[1], small(sums[2].astype(np.int64)), small(np.bincount(doc, weights=times, minlength=n_docs).astype(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        slot = None
        for batch in batches:
            for i in range(batch.num_rows):
                s, kind, flush, blob = (batch.column(c)[i].as_py() for c in range(4))
                if s != slot:
                    slot, known = s, {}
                if kind == 0:
                    word, total, per, low, high, many = unpack(blob)
                    place = np.repeat(np.arange(len(word)), per)
                    key = place << CONTEXT_BITS
                    key |= low.astype(np.int64) | high.astype(np.int64) << 16
                    known = {"word": word, "total": total, "key": key, "many": np.unpackbits(many, count=len(place)).astype(bool), "root": [], "seats": []}
                    del place, low, high
                elif kind < REQUEST:
                    once, at, _, n, t, root = unpack(blob)
                    totals = shared.value[kind - 1]
                    seats = np.full(len(known["key"]), 1 - totals.discounts[0])
                    seats[known["many"]] = n - totals.discounts[0] * t
                    known["seats"].append(seats)
                    customers = once.astype(np.int64) + np.bincount(at, weights=t, minlength=len(once))
                    known["root"].append(totals.root(customers, root.astype(np.int64)))
                else:
                    yield pa.RecordBatch.from_arrays([pa.array([flush], pa.int64()), pa.array([pack(*answers(known, blob))], pa.binary())], ["flush", "blob"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs in by_group(batches, 0, 1):
            total = None
            for blob in blobs:
                ids, flags, *sums = unpack(blob)
                total = sums if total is None else [a + b.astype(a.dtype if a.dtype.kind == "f" else np.int64) for a, b in zip(total, sums, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64(), mask=(flags & 1).astype(bool)), pa.array((flags & 2) > 0), pa.array(total[3].astype(np.int64)), pa.array(total[2].astype(np.int64)), pa.array(total[1]), pa.array(total[0])],
                [key, "held_out", "n_tokens", "n_known", "base_score", "score"],
            )

    parts = wanted.mapInArrow(run, "flush long, blob binary")
    parts = parts.repartition(max(input_partitions(docs), 1), "flush").sortWithinPartitions("flush", F.xxhash64("blob"))
    return parts.mapInArrow(finish, f"{key} long, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def perplexity(scored: DataFrame) -> DataFrame:
    """(held_out, perplexity, base_perplexity) over all tokens."""
    of = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scored.groupBy("held_out").agg(of("score").alias("perplexity"), of("base_score").alias("base_perplexity"))


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Learns from the rows whose crc32 of the id, as text, isn't divisible by 10, and scores all rows."""
    if dict(docs.dtypes)[key] not in ("tinyint", "smallint", "int", "bigint"):  # scored by row, and joined with the keys after
        rows = materialize(docs.select(F.col(key).alias("__key"), F.col(text).alias("text")).withColumn("__row", F.monotonically_increasing_id()))
        scored = _scored(rows, "__row", "text", F.col("__key"))
        return rows.select("__row", F.col("__key").alias(key)).join(scored, "__row").drop("__row")
    return _scored(docs, key, text, F.col(key))


def _scored(docs: DataFrame, key: str, text: str, name: Column) -> DataFrame:
    held = F.crc32(F.coalesce(name.cast("string"), F.lit("")).cast("binary")) % 10 == 0
    own = docs.select(F.col(key), F.col(text).alias("text"), held.alias("held"), (~held).alias("learned"))
    shards = max(4, input_partitions(docs))
    model = fit(own, shards)
    scored = score(own, model, key)
    return scored.withColumn("train_tokens", F.lit(model.numbers[0]).cast("long"))


def op2_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op2_pitman_yor": op2_pitman_yor}
ORACLES: dict[str, str] = {}
