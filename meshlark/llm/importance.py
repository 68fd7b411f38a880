"""Quality classifier by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

Words and word pairs of each whole text are hashed into BUCKETS.  Two generative models, bags of buckets with add-one
smoothing, are counted: of the target (labelled rows of good quality that aren't toxic) and of all raw rows.  A text's
log weight is the sum over its n-grams of the log ratio of the two; with Gumbel noise drawn from its id added, the
KEEP share of rows with the largest sums is a sample without replacement in proportion to the weights.

The models are vectors of BUCKETS numbers, whatever the size of the corpus, so they may be broadcast.  The k-th largest
score is found exactly, by counting scores within ever narrower intervals; no row is sorted or collected for it.

Cases: null or empty texts have log weight 0.  Rows that tie with the k-th score are all kept, so repeated rows stay or
go together.  Null ids share one draw.  Without target rows both models are the raw one.  Labels with null or repeated
ids don't multiply rows.  Columns that clash with outputs are replaced.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlark.llm._common import bounded, materialize, mix, scan_words, table, utf8

BUCKETS = 1 << 14
KEEP = 0.8
_PAIR = np.uint64(0x9FB21C651E98DF25)


def features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Blocks of texts: the bucket of each n-gram, its row, and the number of rows."""
    raw, starts = utf8(column)
    first, n = 0, len(column)
    while first < n:
        last = max(int(np.searchsorted(starts, starts[first] + (1 << 20), side="right")) - 1, first + 1)
        w = scan_words(raw[starts[first] : starts[last]], starts[first : last + 1] - starts[first], lower=True)
        pair = mix(w.hash[:-1] * _PAIR + w.hash[1:])
        inside = w.doc[:-1] == w.doc[1:]
        grams = np.concatenate([w.hash, pair[inside]])
        yield (grams >> np.uint64(50)).astype(np.int64), np.concatenate([w.doc, w.doc[:-1][inside]]), last - first
        first = last


def count_models(docs: DataFrame) -> np.ndarray:
    """2 x BUCKETS: n-grams of all rows and of target rows; docs: (text, target)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            target = batch.column(1).fill_null(False).to_numpy(zero_copy_only=False)
            at = 0
            for gram, doc, n in features(batch.column(0)):
                counts[0] += np.bincount(gram, minlength=BUCKETS)
                counts[1] += np.bincount(gram[target[at : at + n][doc]], minlength=BUCKETS)
                at += n
        some = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[0][some]), pa.array(counts[1][some])], ["bucket", "raw", "target"])

    parts = docs.select("text", "target").mapInArrow(run, "bucket long, raw long, target long")
    out = np.zeros((2, BUCKETS), np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():  # BUCKETS rows at most
        out[:, r["bucket"]] = r["raw"], r["target"]
    return out


def log_ratio(counts: np.ndarray) -> np.ndarray:
    if not counts[1].sum():
        return np.zeros(BUCKETS)
    model = np.log(counts + 1.0) - np.log(counts.sum(axis=1, keepdims=True) + float(BUCKETS))
    return model[1] - model[0]


def log_weights(docs: DataFrame, ratio: np.ndarray, key: str) -> DataFrame:
    """(key, log_weight) of docs (key, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for gram, doc, n in features(batch.column(1)):
                total = np.bincount(doc, weights=shared.value[gram], minlength=n)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), pa.array(total)], [key, "log_weight"])
                at += n

    return docs.select(key, "text").mapInArrow(run, f"{key} {kind}, log_weight double")


def gumbel(key: Column) -> Column:
    """Standard Gumbel noise that depends on the key alone."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit("gumbel"), F.coalesce(key.cast("string"), F.lit("")))), 1, 12), 16, 10).cast("double")
    return -F.log(-F.log((bits + 0.5) / F.lit(float(1 << 48))))


def kth_largest(df: DataFrame, column: str, k: int, few: int = 1 << 16, bins: int = 4096) -> float | None:
    """The k-th largest value, exactly: intervals are narrowed by counts until few values are left in one."""
    if k <= 0:
        return None
    low, high, n = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if n <= k:
        return low
    while low < high and n > few:
        width = (high - low) / bins
        at = F.least(F.greatest(F.floor((F.col(column) - F.lit(low)) / F.lit(width)), F.lit(0)), F.lit(bins - 1)).alias("at")
        held = df.where((F.col(column) >= F.lit(low)) & (F.col(column) <= F.lit(high)))
        counts = held.groupBy(at).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).orderBy(F.desc("at")).collect()  # bins rows
        for r in counts:
            if k <= r["n"]:
                low, high, n = r["low"], r["high"], r["n"]
                break
            k -= r["n"]
    if low == high:
        return low
    left = df.where((F.col(column) >= F.lit(low)) & (F.col(column) <= F.lit(high))).select(column)
    return sorted((r[0] for r in left.collect()), reverse=True)[k - 1]  # few values


def resample(docs: DataFrame, target_ids: DataFrame, key: str = "doc_id", text: str = "text", keep: float = KEEP) -> DataFrame:
    """(key, log_weight, score, kept); target_ids has the key of the rows that stand for the target."""
    ids = materialize(target_ids.select(F.col(key).alias("__id")).where("__id IS NOT NULL").distinct())
    own = docs.select(F.col(key), F.col(text).alias("text"))
    marked = own.join(bounded(ids).withColumn("target", F.lit(True)), own[key] == F.col("__id"), "left")
    ratio = log_ratio(count_models(marked))
    scored = materialize(log_weights(own, ratio, key).withColumn("score", F.col("log_weight") + gumbel(F.col(key))))
    least = kth_largest(scored, "score", round(keep * scored.count()))
    return scored.withColumn("kept", F.lit(False) if least is None else F.col("score") >= F.lit(least))


def op3_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0").select("doc_id")
    return resample(table(spark, sf_dir, "documents"), good)


QUERIES = {"op3_importance_resampling": op3_importance_resampling}
ORACLES: dict[str, str] = {}
