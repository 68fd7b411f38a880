import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from meshlark.llm import pitman_yor as Y
from tests.llm.conftest import prose


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_base_columns(awkward, nothing, clashing):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
    count = Counter(w for d, t in rows if not held(d) for w in [*words(t), None])
    n, v = sum(count.values()), len(count)
    got = Y.score_documents(clashing(awkward)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    for d, t in rows:
        own, r = [*words(t), None], by[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(d), len(own), sum(count[w] > 0 for w in own), n)
        want = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        assert abs(r["base_score"] - want) < 1e-8 * abs(want)
        assert r["score"] < 0
    assert Y.score_documents(nothing).count() == 0


def test_held_out_perplexity(spark):
    """Texts of a chain of words: the model of contexts beats the base of single words by far."""
    rows = []
    for i in range(400):
        x, out = i, []
        for k in range(60):
            x = (x * 5 + 3 + (k * i) % 3) % 211
            out.append(f"w{x}")
        rows.append((i, " ".join(out)))
    out = {r["held_out"]: r for r in Y.perplexity(Y.score_documents(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert out[True]["perplexity"] < 0.2 * out[True]["base_perplexity"]


def test_same_result_however_rows_are_dealt(spark):
    rows = [(i, prose(i % 17, 40)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("text", "t")
    held = lambda d: d.selectExpr("doc_id", "t AS text", "doc_id % 5 = 0 AS held", "doc_id % 5 <> 0 AS learned")
    got = []
    for parts in (1, 3):
        own = held(df.repartition(parts, "doc_id"))
        got.append({r["doc_id"]: r["score"] for r in Y.score(own, Y.fit(own, 4)).collect()})
    assert got[0].keys() == got[1].keys() and all(abs(got[0][k] - got[1][k]) < 1e-6 for k in got[0])


def test_probabilities_sum_to_one(spark):
    """Over the known words and one unknown word, after any context."""
    rows = [(i, prose(i % 5, 12)) for i in range(20)]
    vocabulary = sorted({w for _, t in rows for w in words(t)})
    learned = [(d, t, False, True) for d, t in rows]
    probe = [(1000 + i, f"the {w}", True, False) for i, w in enumerate([*vocabulary, "neverseen"])]
    head = [(2000, "the", True, False)]
    df = spark.createDataFrame(learned + probe + head, "doc_id long, text string, held boolean, learned boolean")
    model = Y.fit(df, 4)
    score = {r["doc_id"]: r["score"] for r in Y.score(df.where("held"), model).collect()}
    # P(the) P(w | the) P(end | w): take out the first and last by probing them apart
    single = spark.createDataFrame([(i, w, True, False) for i, w in enumerate([*vocabulary, "neverseen"])], df.schema)
    alone = {r["doc_id"]: r["score"] for r in Y.score(single, model).collect()}
    assert len(score) == len(probe) + 1 and all(x < 0 for x in alone.values())
    total = sum_after(model, df, "the", vocabulary)
    assert abs(total - 1) < 1e-9


def sum_after(model, df, context, vocabulary):
    """The sum over words of P(word | context), from the model's own tables."""
    u = int(np.uint64(Y.mix(hash_of([context]))[0]) >> np.uint64(64 - Y.CONTEXT_BITS))
    t, state = model.totals, [s.collect() for s in model.states]
    out = 0.0
    for k, own in enumerate(t):
        back, over = Y.STRENGTH + own.discounts[0] * own.tables[u], 1 / (Y.STRENGTH + own.customers[u])
        part = 0.0
        for row, (_, blob) in zip(sorted(model.model.collect()), sorted((r[0], r[1]) for r in state[k]), strict=True):
            word, total, per, low, high, many = Y.unpack(row[1])
            place = np.repeat(np.arange(len(word)), per)
            at = low.astype(np.int64) | high.astype(np.int64) << 16
            once, where, ctx, n, tables, root = Y.unpack(blob)
            customers = once.astype(np.int64) + np.bincount(where, weights=tables, minlength=len(once))
            p = own.root(customers, root.astype(np.int64))
            seats = np.full(len(place), 1 - own.discounts[0])
            seats[np.unpackbits(many, count=len(place)).astype(bool)] = n - own.discounts[0] * tables
            part += float((p * back).sum() + seats[at == u].sum()) * over
        part += own.root(np.zeros(1), np.zeros(1))[0] * back * over
        out += part / len(t)
    return out


def hash_of(tokens):
    return np.concatenate([w[:-1] for w, *_ in Y.tokens_of(pa.array(tokens))])


def test_ids_of_other_types(spark):
    """Text ids: the same scores as the numbers that they write."""
    rows = [(i, prose(i % 7, 30)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    want = {str(r["doc_id"]): tuple(r)[1:] for r in Y.score_documents(df).collect()}
    got = {r["doc_id"]: tuple(r)[1:] for r in Y.score_documents(df.selectExpr("CAST(doc_id AS STRING) AS doc_id", "text")).collect()}
    assert got.keys() == want.keys() and all(abs(a - b) < 1e-6 for k in want for a, b in zip(got[k], want[k], strict=True))


class Plain:
    """The same hierarchy, seated customer by customer: tables as lists of their sizes."""

    def __init__(self, texts, discounts, seed):
        self.d, self.random = discounts, random.Random(seed)
        self.tokens = [(u, w) for t in texts for u, w in zip([None, *words(t)], [*words(t), None], strict=True)]
        self.size = len({w for _, w in self.tokens})
        self.tables, self.root = defaultdict(list), defaultdict(list)  # by (context, word), by word
        self.of_context = defaultdict(lambda: [0, 0])  # customers and tables
        self.of_root = [0, 0]
        for u, w in self.tokens:
            self.sit(u, w)

    def p_root(self, w):
        own = self.root[w]
        return (sum(own) - self.d[1] * len(own) + (1 + self.d[1] * self.of_root[1]) / (self.size + 1)) / (1 + self.of_root[0])

    def p(self, u, w):
        own, (c, t) = self.tables[u, w], self.of_context[u]
        return (sum(own) - self.d[0] * len(own) + (1 + self.d[0] * t) * self.p_root(w)) / (1 + c)

    def choose(self, sizes, discount, more):
        x = self.random.random() * (sum(sizes) - discount * len(sizes) + more)
        for i, n in enumerate(sizes):
            x -= n - discount
            if x < 0:
                return i
        return len(sizes)

    def sit(self, u, w):
        own, total = self.tables[u, w], self.of_context[u]
        i = self.choose(own, self.d[0], (1 + self.d[0] * total[1]) * self.p_root(w))
        total[0] += 1
        if i < len(own):
            own[i] += 1
            return
        own.append(1)
        total[1] += 1
        top = self.root[w]
        j = self.choose(top, self.d[1], (1 + self.d[1] * self.of_root[1]) / (self.size + 1))
        self.of_root[0] += 1
        if j < len(top):
            top[j] += 1
        else:
            top.append(1)
            self.of_root[1] += 1

    def leave(self, u, w):
        own, total = self.tables[u, w], self.of_context[u]
        i = self.random.choices(range(len(own)), own)[0]
        own[i] -= 1
        total[0] -= 1
        if own[i]:
            return
        own.pop(i)
        total[1] -= 1
        top = self.root[w]
        j = self.random.choices(range(len(top)), top)[0]
        top[j] -= 1
        self.of_root[0] -= 1
        if not top[j]:
            top.pop(j)
            self.of_root[1] -= 1

    def sweep(self):
        for u, w in self.tokens:
            self.leave(u, w)
            self.sit(u, w)


def test_scores_against_a_plain_sampler(spark):
    """Average predictive probabilities of the parallel sweeps and of a sampler that moves a customer at a time."""
    r = random.Random(9)
    texts = [" ".join(f"w{min(int(r.expovariate(0.4)), 9)}" for _ in range(12)) for _ in range(40)]
    probes = texts[:5] + ["w0 w1 w2 w3 w9", "never w0 seen", ""]
    df = spark.createDataFrame([(i, t, False, True) for i, t in enumerate(texts)] + [(1000 + i, t, True, False) for i, t in enumerate(probes)], "doc_id long, text string, held boolean, learned boolean").coalesce(1)
    model = Y.fit(df, 1, sweeps=30, samples=20)
    got = {x["doc_id"]: x for x in Y.score(df.where("held"), model).collect()}
    plain = Plain(texts, model.totals[-1].discounts, 1)
    total = [[0.0] * (len(words(t)) + 1) for t in probes]
    for k in range(600):
        plain.sweep()
        if k >= 100:
            for row, t in zip(total, probes, strict=True):
                for i, (u, w) in enumerate(zip([None, *words(t)], [*words(t), None], strict=True)):
                    row[i] += plain.p(u, w) / 500
    for i, row in enumerate(total):
        want = sum(map(math.log10, row))
        assert abs(got[1000 + i]["score"] - want) < 0.05 + 0.02 * len(row), (i, got[1000 + i]["score"], want)


def test_folded_counts_are_the_counts(spark, monkeypatch):
    rows = [(prose(i % 9, 60), True) for i in range(80)]
    df = spark.createDataFrame(rows, "text string, learned boolean").repartition(6)
    blobs = [r["blob"] for r in Y.gather_counts(df, 1).collect()]
    assert len(blobs) > 2
    want = Y.cells_of(blobs)
    batches = [pa.RecordBatch.from_arrays([pa.array([0] * len(blobs)), pa.array(blobs, pa.binary())], ["k", "v"])]
    monkeypatch.setattr(Y, "FOLDED", 100)
    ((_, folded),) = Y.by_group(iter(batches), 0, 1, lambda own: Y.count_blob(*Y.cells_of(own)))
    assert len(folded) < len(blobs) and all(np.array_equal(a, b) for a, b in zip(Y.cells_of(folded), want, strict=True))


def test_stirling_numbers():
    s = np.exp(Y.log_stirling(0.5, 4))
    assert np.allclose(s[3, 1:4], [0.5 * 1.5, 1.5, 1]) and np.allclose(s[4, 4], 1) and np.allclose(s[4, 1], 0.5 * 1.5 * 2.5)


def test_drawn_tables_follow_the_conditional():
    n = np.full(20000, 6)
    t = Y.draw_tables(n, np.full(len(n), 0.05), np.full(len(n), 10), 0.6, 1.0, np.random.default_rng(1))
    w = np.array([np.exp(Y.log_stirling(0.6, 6)[6, k]) * np.prod([1 + 0.6 * (10 + j) for j in range(k)]) * 0.05**k for k in range(1, 7)])
    assert np.abs(np.bincount(t, minlength=7)[1:] / len(t) - w / w.sum()).max() < 0.015


def test_large_cells_continue_small_ones():
    """The approximation for large cells agrees in the mean with the exact conditional at the border."""
    c = Y.EXACT
    for base in (0.001, 0.05):
        args = np.full(4000, base), np.full(4000, 50), 0.7, 1.0
        small = Y.draw_tables(np.full(4000, c), *args, np.random.default_rng(1)).mean()
        large = Y.draw_tables(np.full(4000, c + 1), *args, np.random.default_rng(2)).mean()
        assert abs(large / small - 1) < 0.15


def test_packing():
    arrays = [np.arange(5, dtype=np.uint64), np.zeros(0), np.array([1, 300], np.uint16), np.array([True, False])]
    assert all(np.array_equal(a, b) and a.dtype == b.dtype for a, b in zip(arrays, Y.unpack(Y.pack(*arrays)), strict=True))
