import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa

from meshlark.llm import near_dedup as D
from tests.llm.conftest import prose


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [shingle_set(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if (rows[i][1] or "") == (rows[j][1] or "") or (common and common >= 0.8 * len(sets[i] | sets[j]) - 1e-9):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        groups[find(i)].append(d)
    return {d: min(g) for g in groups.values() for d in g}


def changed(text, n, r):
    w = text.split(" ")
    for _ in range(n):
        w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
    return " ".join(w)


def test_against_all_pairs(spark):
    r = random.Random(3)
    texts = [prose(i, r.choice([30, 100, 300])) for i in range(30)]
    rows = [(i, t) for i, t in enumerate(texts)]
    for k in range(90):
        base = r.choice(texts)
        rows.append((100 + k, changed(base, r.choice([0, 0, 1, 2, 3]), r)))
    rows += [(500 + i, t) for i, t in enumerate(["", "", None, "one two", "one  two", "one two three", "   "])]
    got = {x["doc_id"]: x["class_id"] for x in D.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_large_group_with_a_common_source(spark):
    """Near copies of one text that are often not near each other: all are one class through the text."""
    r = random.Random(4)
    base = prose(77, 400)
    rows = [(i, changed(base, 8, r)) for i in range(400)] + [(1000, base)]
    got = {x["class_id"] for x in D.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0}


def test_sketch_estimates_probability_jaccard():
    a = {i: 1.0 + i % 3 for i in range(200)}
    b = {i: 1.0 + (i + 1) % 3 for i in range(60, 260)}
    want = sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in a.keys() | b.keys()) for i in a.keys() & b.keys())
    s = D.mix(np.array([*a, *b], dtype=np.uint64))
    doc = np.array([0] * len(a) + [1] * len(b))
    own = D.prob_minhash(s, doc, np.array([*a.values(), *b.values()]), 2, 4096)
    assert abs((own[0] == own[1]).mean() - want) < 0.04


def test_sketch_of_one_shingle_fills_all_slots():
    own = D.prob_minhash(np.array([5], np.uint64), np.array([0]), np.array([1.0]), 1, 125)
    assert (own == 5).all()


def test_blocks_of_texts_do_not_change_shingles():
    texts = [prose(i, 50) for i in range(5)] + ["", "a", "a b c d e", "a b c d e f"]
    whole = list(D.shingles(pa.array(texts)))
    assert len(whole) == 1
    s, doc, n = whole[0]
    assert n == len(texts)
    for i, t in enumerate(texts):
        assert len(set(s[doc == i].tolist())) == len(shingle_set(t))


def test_awkward_rows(awkward, nothing, clashing):
    docs = clashing(awkward)
    got = D.classes(docs).collect()
    assert len(got) == awkward.count()
    by = defaultdict(set)
    for r in got:
        by[r["doc_id"]].add(r["class_id"])
    assert by[6] == {1} and by[3] == {3} and by[4] == {3} and by[7] == {7}
    kept = D.filter_documents(docs)
    assert kept.columns == docs.columns and {(r["node"], r["kept"]) for r in kept.collect()} == {(7, 7)} and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 5, 7, 8, 9, 10, 11, 12]
    assert D.classes(nothing).count() == 0


def test_repeated_lines_part_no_pair(spark):
    """A line repeated 300 times leaves the distinct shingles alike (500 of 512) but not the weighted ones."""
    texts = [prose(i, 504) for i in range(5)]
    line = " ".join(f"pad{j}" for j in range(12))
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, t + ("\n" + line) * 300) for i, t in enumerate(texts)]
    got = {x["doc_id"]: x["class_id"] for x in D.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows) == {i: i % 100 for i, _ in rows}


def test_rows_compared_follow_the_size_of_a_bucket(spark, monkeypatch):
    """Texts of one bucket that share a passage but are not alike, with some that are: all links, and no blocks of all pairs."""
    r = random.Random(5)
    passage = prose(88, 200)
    rows = [(i, passage + " " + " ".join(f"own{i}x{j}" for j in range(r.randrange(30, 60)))) for i in range(400)]
    rows += [(1000 + i, changed(rows[i][1], 2, r)) for i in range(0, 400, 40)]
    seen, compare = [], D.compare

    def counted(texts, wanted, least):
        seen[-1] += wanted.count()
        return compare(texts, wanted, least)

    def one_bucket(docs, bands, size):
        return D.materialize(docs.selectExpr("1L AS key", "node", "1L AS degree")), D.materialize(docs)

    monkeypatch.setattr(D, "compare", counted)
    monkeypatch.setattr(D, "buckets", one_bucket)
    for n in (200, 400):
        own = [x for x in rows if x[0] % 1000 < n]
        seen.append(0)
        got = {x["doc_id"]: x["class_id"] for x in D.classes(spark.createDataFrame(own, "doc_id long, text string")).collect()}
        assert got == brute(own) and len(set(got.values())) == n
    assert seen[1] < 2.5 * seen[0]
