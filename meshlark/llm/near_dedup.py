"""MinHash near-dedup: ProbMinHash of weighted word shingles, banding, exact verification, connected classes.

1. Nodes are distinct texts (by md5), so copies are one node however many there are.
2. A node's five-word shingles with their counts as weights are sketched by ProbMinHash: every shingle is a Poisson
   process whose rate is its weight; each arrival hits a random slot, a slot keeps its earliest arrival, and a process
   ends as soon as its next arrival is later than all slots' (early termination).  Two sketches agree in a slot with the
   probability Jaccard similarity of the weighted shingles.  A node that repeats shingles is sketched with unit weights,
   too, which is all there is to sketch of others: by these two nodes agree with their similarity of distinct shingles,
   the one that is verified, so repeated lines part no pair.
3. BANDS keys of ROWS slots each, of each sketch, put nodes into buckets.  In a bucket all members are compared with its
   centre, the member with the most bucket company.  Components of these links come next, over all buckets; buckets that
   lie in one component are done.  Another round of centres follows while a round leaves half as much to compare or less;
   then members of buckets with more than one component meet by their rarest shingles (prefix and length filters, which
   lose no similar pair), and those of different components are compared, in blocks of bounded size.
   Pairs are never emitted, only verified links; similar members of a bucket always end in one component.
4. Verified: at least 0.8 of the distinct shingles of both are common.  Classes are the connected components.

Cases: null text is the empty text.  A text of one to four words is a single shingle; texts without words are alike only
if equal.  Rows that repeat an id and a text are one document.  Null ids take part; a class is named by its smallest id,
null if it has none, and its document of that id (of several, the one of the smallest md5) stays.  Very long texts are
whole.  classes returns its own columns alone; filter_documents returns docs' columns as they are, whatever their names.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlark.llm._common import apart, bounded, checkpoint_dir, cut, materialize, mix, scan_words, spread, table, utf8

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 25, 5
#: Members of a bucket that one task row compares at once: left against right.
LEFT, RIGHT = 64, 256
#: Comparisons left for each row of the buckets below which another round of centres isn't worth its jobs.
FEW_PAIRS = 16

_STEP = np.uint64(0x9E3779B97F4A7C15)
_K = np.uint64(0xA0761D6478BD642F)


def node(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def shingles(column: pa.Array, size: int = WORDS) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Blocks of texts: hashes of their shingles, the row of each, and the number of rows."""
    raw, starts = utf8(column)
    first, n = 0, len(column)
    while first < n:
        last = max(int(np.searchsorted(starts, starts[first] + (1 << 20), side="right")) - 1, first + 1)
        w = scan_words(raw[starts[first] : starts[last]], starts[first : last + 1] - starts[first], lower=False)
        count = np.diff(w.doc_start)
        total = len(w.hash)
        full = max(total - size + 1, 0)
        s = np.zeros(full, np.uint64)
        for j in range(size):
            s = s * _K + w.hash[j : j + full]
        doc = w.doc[:full]
        inside = doc == w.doc[size - 1 : size - 1 + full]
        s, doc = mix(s[inside]), doc[inside]
        short = np.flatnonzero((count > 0) & (count < size))
        if len(short):
            extra = np.empty(len(short), np.uint64)
            for i, d in enumerate(short):
                h = np.uint64(1)
                with np.errstate(over="ignore"):
                    for x in w.hash[w.doc_start[d] : w.doc_start[d + 1]]:
                        h = h * _K + x
                extra[i] = h
            s, doc = np.concatenate([s, mix(extra)]), np.concatenate([doc, short])
        yield s, doc, last - first
        first = last


def weighted(s: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each row, in order of row and hash, and how often each occurs."""
    order = np.lexsort((s, doc))
    s, doc = s[order], doc[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return s[at], doc[at], np.diff(np.append(at, len(s)))


def prob_minhash(s: np.ndarray, doc: np.ndarray, weight: np.ndarray, n: int, slots: int) -> np.ndarray:
    """n x slots: the element that arrives first at each slot, of the weighted elements s of each row doc."""
    first = np.full(n * slots, np.inf)
    owner = np.zeros(n * slots, np.uint64)
    live = np.arange(len(s))
    time = np.zeros(len(s))
    rate = 1.0 / weight
    step = np.uint64(0)
    while len(live):
        many = int(min(max(32768 // len(live), 1), 64))  # arrivals of each process at once
        turn = (step + np.arange(1, many + 1, dtype=np.uint64)) * _STEP
        h = mix((s[live][:, None] ^ turn[None, :]).ravel()).reshape(len(live), many)
        gap = -np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) * rate[live][:, None]
        at = time[live][:, None] + np.cumsum(gap, axis=1)
        time[live] = at[:, -1]
        last = first.reshape(n, slots).max(axis=1)
        r, c = np.nonzero(at < last[doc[live]][:, None])
        slot = doc[live][r] * slots + (mix(h[r, c] + _K) % np.uint64(slots)).astype(np.int64)
        x = at[r, c]
        np.minimum.at(first, slot, x)
        won = first[slot] == x
        owner[slot[won]] = s[live][r[won]]
        last = first.reshape(n, slots).max(axis=1)
        live = live[time[live] < last[doc[live]]]
        step += np.uint64(many)
    return owner.reshape(n, slots)


def band_keys(owner: np.ndarray, bands: int, rows: int) -> np.ndarray:
    key = np.zeros((len(owner), bands), np.uint64)
    for j in range(rows):
        key = key * _K + mix(owner[:, j::rows][:, :bands])
    return mix(key + np.arange(1, bands + 1, dtype=np.uint64)[None, :] * _STEP).view(np.int64)


def sketch(texts: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """texts (node, text) to (node, bands); null bands for a text without words.

    bands are those of the sketch with unit weights, then, if a shingle is repeated, those of the weighted one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for s, doc, n in shingles(batch.column(1)):
                s, doc, weight = weighted(s, doc)
                key = band_keys(prob_minhash(s, doc, np.ones(len(s)), n, bands * rows), bands, rows)
                again = np.zeros(n, bool)
                again[doc[weight > 1]] = True
                own = again[doc]
                at_again = (np.cumsum(again) - 1)[doc[own]]
                more = band_keys(prob_minhash(s[own], at_again, weight[own].astype(np.float64), int(again.sum()), bands * rows), bands, rows)
                both = np.concatenate([key, np.zeros_like(key)], axis=1)
                both[again, bands:] = more
                used = np.repeat(np.stack([np.ones(n, bool), again], axis=1), bands, axis=1)
                some = np.zeros(n, bool)
                some[doc] = True
                offsets = np.concatenate([[0], np.cumsum(used.sum(axis=1))]).astype(np.int32)
                keys = pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(~some, False)), pa.array(both[used]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), keys], ["node", "bands"])
                at += n

    return texts.mapInArrow(run, "node binary, bands array<bigint>")


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether two sorted sets of shingles have at least this Jaccard similarity; a text without words is like none."""
    small, large = sorted((len(a), len(b)))
    if not small or small < least * large:
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common >= least * (small + large - common) - 1e-9


def compare(texts: DataFrame, wanted: DataFrame, least: float) -> DataFrame:
    """Links (a, b) within groups: wanted has (group, node, side); every left is compared with every right of its group.

    texts: (node, text), a row a node.  A pair that the group's links already connect is passed over.
    Memory: a group's shingles; a group has about LEFT + RIGHT nodes at most.
    """
    placed = texts.join(bounded(materialize(wanted)), "node")
    rows = spread(placed, "group").sortWithinPartitions("group", "side", "node").select("group", "side", "node", "text")

    def links(group: list[tuple[int, bytes, np.ndarray]]) -> Iterator[tuple[bytes, bytes]]:
        root = {n: n for _, n, _ in group}

        def find(x: bytes) -> bytes:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        left = [x for x in group if x[0] == 0]
        right = [x for x in group if x[0] == 1]
        for _, a, sa in left:
            for _, b, sb in right:
                if find(a) != find(b) and similar(sa, sb, least):
                    root[find(b)] = find(a)
                    yield a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        now = None

        def flush() -> pa.RecordBatch:
            found = list(links(held))
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.binary()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            group, side, name = (batch.column(i).to_pylist() for i in range(3))
            at = 0
            for s, doc, n in shingles(batch.column(3)):
                s, doc, _ = weighted(s, doc)
                bound = np.searchsorted(doc, np.arange(n + 1))
                for i in range(n):
                    g = group[at + i]
                    if g != now and held:
                        yield flush()
                        held = []
                    now = g
                    held.append((side[at + i], name[at + i], s[bound[i] : bound[i + 1]].copy()))
                at += n
        if held:
            yield flush()

    return rows.mapInArrow(run, "a binary, b binary")


def buckets(docs: DataFrame, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """Of docs (node, text): (key, node, degree) of the buckets with two nodes or more, and (node, text) of these nodes."""
    keyed = materialize(sketch(docs, bands, rows).where("bands IS NOT NULL"))
    placed = keyed.groupBy("node").agg(F.first("bands").alias("bands")).select("node", F.explode(F.array_distinct("bands")).alias("key"))
    sizes = placed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    placed = materialize(placed.join(sizes, "key"))
    degree = materialize(placed.groupBy("node").agg(F.sum("size").alias("degree")))
    # copies of a text meet in the aggregate's map side, so a row a text is moved
    texts = docs.join(bounded(degree.select("node")), "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    return materialize(placed.join(degree, "node").select("key", "node", "degree")), materialize(texts)


def star(state: DataFrame, turn: int) -> DataFrame:
    """Wanted groups: each bucket's members outside its centre's component with the centre, in groups of about RIGHT.

    state: (key, node, degree, root).  The centre is of the bucket's largest component: at first the node with the most
    bucket company, in later turns another by hash.
    """
    rank = F.xxhash64(F.lit(turn), "node") if turn else F.col("degree")
    size = state.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct(rank.alias("rank"), "node")).alias("top"))
    centre = size.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("n", "top", "root")).alias("c")).where("parts > 1")
    centre = centre.select("key", F.col("c.top.node").alias("centre"), F.col("c.root").alias("main"))
    rays = materialize(state.join(centre, "key").where("root != main").select("node", "centre").distinct())
    # centres of more than one group have RIGHT * 0.8 rays or more each, so they are few against the rays
    groups = rays.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / F.lit(RIGHT * 0.8)).alias("groups")).where("groups > 1")
    rays = rays.join(bounded(materialize(groups)), "centre", "left")
    rays = rays.withColumn("group", F.xxhash64("centre", F.pmod(F.xxhash64("node"), F.coalesce("groups", F.lit(1)))))
    return rays.select("group", "node", F.lit(1).alias("side")).unionByName(rays.select("group", F.col("centre").alias("node"), F.lit(0).alias("side")).distinct())


def shingle_sets(texts: DataFrame) -> DataFrame:
    """texts (node, root, text) to (node, root, shingles): the distinct ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for s, doc, n in shingles(batch.column(2)):
                s, doc, _ = weighted(s, doc)
                offsets = pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32))
                sets = pa.ListArray.from_arrays(offsets, pa.array(s.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), batch.column(1).slice(at, n), sets], ["node", "root", "shingles"])
                at += n

    return texts.select("node", "root", "text").mapInArrow(run, "node binary, root binary, shingles array<bigint>")


def prefixes(sets: DataFrame, least: float) -> DataFrame:
    """(key, sets, node, root, n, most) of sets (node, root, shingles): the rarest shingles of each that others have, too.

    Of a set of n these are among the n - ceil(least n) + 1 that the fewest sets have.  Alike sets have at least ceil(least n)
    in common, for the n of either, so by one order of all shingles the first that they share is among the rarest of both.
    Texts with as many shingles of their own meet none, however much else they share.  most: the size of the largest set
    that can be alike if this shingle is the first that is shared, as no more than those after it can be shared then.
    """
    each = sets.select("node", F.explode("shingles").alias("key"))
    shared = materialize(each.groupBy("key").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1"))
    known = each.join(bounded(shared), "key").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("sets", "key"))).alias("shared"))
    own = sets.join(known, "node").withColumn("n", F.size("shingles")).withColumn("own", F.col("n") - F.size("shared"))
    rarest = F.col("n") - F.ceil(F.col("n") * F.lit(least) - 1e-9).cast("int") + 1 - F.col("own")
    at = own.select("node", "root", "n", "own", F.posexplode(F.slice("shared", 1, F.greatest(rarest, F.lit(0)))).alias("i", "x"))
    most = (F.col("n") - F.col("own") - F.col("i")) * F.lit((1 + least) / least) - F.col("n") + 1e-6
    return at.select("x.key", "x.sets", "node", "root", "n", most.alias("most"))


def rest(texts: DataFrame, state: DataFrame, least: float) -> DataFrame:
    """Wanted groups that hold all similar nodes of different components of the buckets of state (key, node, degree, root).

    A node of several buckets counts once, and nodes meet by their rarest shingles, not by buckets, whose members all
    look alike.  A node whose size rules out every member of another component goes; so the rows follow the nodes that are
    left, not the squares of their buckets.
    """
    mixed = state.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    held = state.join(mixed, "key", "left_semi").select("node", "root").distinct()
    placed = materialize(prefixes(materialize(shingle_sets(texts.join(bounded(materialize(held)), "node"))), least))
    # of keys of the same nodes, none but the first is the first that two of them share
    same = placed.groupBy("key", "sets").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sum"))
    first = same.where("n > 1").groupBy("n", "sum").agg(F.min(F.struct("sets", "key"))["key"].alias("key")).select("key")
    placed = materialize(placed.join(bounded(materialize(first)), "key"))
    by_root = placed.groupBy("key", "root").agg(F.max("most").alias("most"), F.min("n").alias("n"))
    ends = by_root.groupBy("key").agg(F.max(F.struct("most", "root")).alias("hi"), F.min(F.struct("n", "root")).alias("lo"))
    others = [F.max(F.when(F.col("root") != F.col("hi.root"), F.col("most"))).alias("hi2"), F.min(F.when(F.col("root") != F.col("lo.root"), F.col("n"))).alias("lo2")]
    ends = by_root.join(ends, "key").groupBy("key", "hi", "lo").agg(*others).where("hi2 IS NOT NULL")
    near = placed.join(bounded(materialize(ends)), "key")
    fits = F.col("n") <= F.when(F.col("root") == F.col("hi.root"), F.col("hi2")).otherwise(F.col("hi.most"))
    fits &= F.col("most") >= F.when(F.col("root") == F.col("lo.root"), F.col("lo2")).otherwise(F.col("lo.n"))
    return blocks(materialize(near.where(fits).select("key", "node", "root")))


def blocks(state: DataFrame) -> DataFrame:
    """Wanted groups: each key's members outside its largest component with all its members, in blocks of LEFT and RIGHT."""
    size = state.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    mixed = size.groupBy("key").agg(F.max(F.struct("n", "root"))["root"].alias("main"), F.max("n").alias("most"), F.sum("n").alias("size")).where("most < size")
    mixed = mixed.select("key", "main", F.ceil((F.col("size") - F.col("most")) / F.lit(LEFT * 0.8)).alias("lefts"), F.ceil(F.col("size") / F.lit(RIGHT * 0.8)).alias("rights"))
    held = materialize(state.join(mixed, "key"))
    part = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = held.where("root != main").withColumn("l", part("lefts")).withColumn("r", every("rights"))
    right = held.withColumn("r", part("rights")).withColumn("l", every("lefts"))
    return left.select(F.xxhash64("key", "l", "r").alias("group"), "node", F.lit(0).alias("side")).unionByName(
        right.select(F.xxhash64("key", "l", "r").alias("group"), "node", F.lit(1).alias("side"))
    )


def pairs_left(state: DataFrame) -> int:
    """Comparisons that blocks would make of state (key, node, root): members outside the largest component times members."""
    size = state.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.sum("n").alias("size"), F.max("n").alias("most"))
    return size.agg(F.sum((F.col("size") - F.col("most")) * F.col("size"))).first()[0] or 0


def class_roots(docs: DataFrame, least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(node, root) of the nodes that have a link, by verified links that connect all similar nodes of each bucket.

    docs: (node, text), copies or not.
    """
    placed, texts = buckets(docs, bands, rows)
    few = FEW_PAIRS * placed.count()
    found, roots, left = None, None, None
    for turn in count():
        state = placed.withColumn("root", F.col("node")) if roots is None else placed.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        state = materialize(state)
        before, left = left, pairs_left(state)
        if not left:
            return roots if roots is not None else state.select("node", "root").limit(0)
        last = before is not None and (left <= few or 2 * left > before)
        more = materialize(compare(texts, rest(texts, state, least) if last else star(state, turn), least))
        found = more if found is None else found.unionByName(more)
        roots = components(found)
        if last:
            return roots


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of links (a, b): root is the smallest node of its component.

    Each round takes the smallest label around a node and then its label's label; the state is cut after every round.
    """
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")))
    while True:
        around = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("m"))
        near = labels.join(around, F.col("node") == F.col("a")).select("node", F.col("root").alias("was"), F.least("root", "m").alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("next"))
        after = cut(near.join(jump, "root", "left").select("node", "was", F.least("root", F.coalesce("next", "root")).alias("root")))
        labels = after.select("node", "root")
        if after.where("root != was").isEmpty():
            return labels


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """(key, node, class_id, kept) for every row of docs."""
    checkpoint_dir(docs.sparkSession)
    texts = docs.select(node(F.col(text)).alias("node"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    roots = class_roots(texts, least)
    named = docs.select(F.col(key), node(F.col(text)).alias("node"))
    named = cut(named.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    order = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), "node")
    first = cut(named.groupBy("root").agg(F.min(order).alias("first")))  # apart, so that AQE may split the join's large classes
    kept = F.col(key).eqNullSafe(F.col("first.id")) & (F.col("node") == F.col("first.node"))
    return named.join(first, "root").select(key, "node", F.col("first.id").alias("class_id"), kept.alias("kept"))


def filter_documents(docs: DataFrame) -> DataFrame:
    """docs with one document of each class, in docs' own columns."""
    gone = materialize(classes(docs).where("NOT kept").select(F.col("doc_id").alias("__id"), F.col("node").alias("__node")).distinct())
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (node(F.col("text")) == F.col("__node"))
    return apart(docs, ("doc_id", "text"), lambda own: own.join(bounded(gone), same, "left_anti"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "kept")


QUERIES = {"op8_near_dedup": op8_near_dedup}
ORACLES: dict[str, str] = {}
