import math
import re
from collections import Counter

import pyarrow as pa

from meshlark.llm import importance as I
from tests.llm.conftest import prose


def grams(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return w + [tuple(x) for x in zip(w, w[1:], strict=False)]


def test_weights_against_counters(spark, awkward, nothing, clashing):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    good = spark.createDataFrame([(1,), (2,), (2,), (None,)], "doc_id long")
    out = {}
    for r in I.resample(clashing(awkward), good).collect():
        out.setdefault(r["doc_id"], r)
    bucket = {}
    for _, t in rows:
        for g in grams(t):
            if g not in bucket:
                one = pa.array([g if isinstance(g, str) else " ".join(g)])
                found = next(iter(I.features(one)))[0]
                bucket[g] = int(found[-1])
    raw, target = Counter(), Counter()
    for d, t in rows:
        for g in grams(t):
            raw[bucket[g]] += 1
            target[bucket[g]] += d in (1, 2)
    n, m = sum(raw.values()), sum(target.values())
    for d, t in rows:
        want = sum(math.log((target[bucket[g]] + 1) / (m + I.BUCKETS)) - math.log((raw[bucket[g]] + 1) / (n + I.BUCKETS)) for g in grams(t))
        assert abs(out[d]["log_weight"] - want) < 1e-6 * max(1, abs(want))
    assert out[3]["log_weight"] == 0 and out[4]["log_weight"] == 0
    assert I.resample(nothing, good).count() == 0
    assert I.resample(awkward, good.limit(0)).count() == awkward.count()


def test_exact_share(spark):
    rows = [(i, prose(i, 10)) for i in range(1000)]
    good = spark.createDataFrame([(i,) for i in range(100)], "doc_id long")
    df = I.resample(spark.createDataFrame(rows, "doc_id long, text string"), good, keep=0.3)
    kept = [r["score"] for r in df.where("kept").collect()]
    assert len(kept) == 300 and min(kept) > max(r["score"] for r in df.where("NOT kept").collect())


def test_kth_largest(spark):
    values = [float((i * 7919) % 1009) for i in range(3000)] + [1e9, -1e9, 0.5] * 2
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 2, 3, 700, 3000, len(values)):
        assert I.kth_largest(df, "v", k, few=5, bins=16) == sorted(values, reverse=True)[k - 1]


def test_held_out_quality(spark, sf_dir):
    """Labelled rows that the models haven't seen: good ones weigh more than bad ones."""
    folder = sf_dir.replace("sf0.001", "sf0.01")  # the smallest tables have too few labels
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    good = labels.where("quality = 1 AND toxic = 0 AND doc_id % 2 = 0").select("doc_id")
    out = I.resample(docs, good).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    high = [r["log_weight"] for r in out if r["quality"] == 1 and r["toxic"] == 0]
    low = [r["log_weight"] for r in out if r["quality"] == 0]
    wins = sum(a > b for a in high for b in low) / max(len(high) * len(low), 1)
    assert wins > 0.75
