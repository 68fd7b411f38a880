"""Sharding by extendible hashing: a directory over hash-prefix bits in which only oversized buckets split.

A document's bucket is a prefix of the bits of a 60-bit hash of its id.  The directory starts as one bucket of depth 0; a
bucket of more bytes than the limit splits on its next bit, until every bucket fits or holds a single id.  Splitting works
on bytes by prefix: those of the longest prefixes that are likely to be needed are summed from the rows, those of shorter
ones from these, and each document's shard is its shortest prefix that fits.  Rows whose longest prefix doesn't fit either,
few as the hash is uniform, go through longer ones.

Cases: a null or empty text has 0 bytes; a null id is hashed as the empty string.  Rows of one id stay in one shard,
even if they exceed the limit, as does a single document longer than the limit: such a shard is marked oversized.
assign has its own columns alone; write_shards replaces a column named shard.  An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlark.llm._common import bounded, cut, materialize, table

HASH_BITS = 60
#: Bytes of text a shard may hold in the queries.
LIMIT = 4 << 20
#: Bits beyond the depth of a mean bucket that the first directory has, and bits added for what doesn't fit in it.
AHEAD, STEP = 3, 8


def hash60(key: Column) -> Column:
    """The first 15 hexadecimal digits of md5, as a number."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def prefix(h: Column, depth: int) -> Column:
    return F.shiftright(h, HASH_BITS - depth)


def assign(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """(key, shard, depth, n_bytes, shard_bytes, shard_rows, oversized) for every row; shard is the prefix in binary."""
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")
    active = cut(docs.select(F.col(key), hash60(F.col(key)).alias("h"), size.alias("n_bytes")))
    total = active.agg(F.sum("n_bytes")).first()[0] or 0
    low, high = 0, min(max(math.ceil(math.log2(max(total, 1) / limit)), 0) + AHEAD, HASH_BITS)
    out = None
    while True:
        # bytes by the prefix of most bits, and from these by all shorter ones: the directory of depths low to high
        fine = active.groupBy(prefix(F.col("h"), high).alias("fine")).agg(
            F.sum("n_bytes").alias("bytes"), F.count(F.lit(1)).alias("rows"), F.min("h").alias("a"), F.max("h").alias("z")
        )
        depths = F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth")
        paths = cut(fine).select("*", depths).withColumn("p", F.expr(f"shiftright(fine, {high} - depth)"))
        buckets = paths.groupBy("depth", "p").agg(F.sum("bytes").alias("shard_bytes"), F.sum("rows").alias("shard_rows"), F.min("a").alias("a"), F.max("z").alias("z"))
        fits = buckets.where((F.col("shard_bytes") <= limit) | (F.col("a") == F.col("z")))
        found = paths.select("fine", "depth", "p").join(fits, ["depth", "p"], "left")
        own = F.when(F.col("shard_bytes").isNotNull(), F.struct("depth", "p", "shard_bytes", "shard_rows"))
        shards = materialize(found.groupBy("fine").agg(F.min(own).alias("s")))
        placed = active.join(bounded(shards), prefix(F.col("h"), high) == F.col("fine"))
        name = F.when(F.col("s.depth") == 0, F.lit("")).otherwise(F.lpad(F.conv(F.col("s.p").cast("string"), 10, 2), F.col("s.depth"), F.lit("0")))
        done = placed.where("s IS NOT NULL").select(
            key, name.alias("shard"), F.col("s.depth").alias("depth"), "n_bytes", F.col("s.shard_bytes").alias("shard_bytes"), F.col("s.shard_rows").alias("shard_rows"),
            (F.col("s.shard_bytes") > limit).alias("oversized"),
        )
        out = done if out is None else out.unionByName(done)
        if shards.where("s IS NULL").isEmpty():
            return out
        active = cut(placed.where("s IS NULL").select(key, "h", "n_bytes"))
        low, high = high + 1, min(high + STEP, HASH_BITS)


def directory(assigned: DataFrame) -> DataFrame:
    """One row a shard."""
    return assigned.groupBy("shard", "depth").agg(F.max("shard_bytes").alias("shard_bytes"), F.max("shard_rows").alias("shard_rows"))


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """Writes docs as Parquet, a folder a shard (shard=s0110; of all at depth 0, shard=s), and returns the assignment."""
    assigned = cut(assign(docs, key, text, limit))
    # named by a letter and the prefix, so that no name is empty or reads as a number
    of = assigned.select(F.col(key).alias("__key"), F.concat(F.lit("s"), "shard").alias("shard")).distinct()
    own = docs.select(*[c for c in docs.columns if c.lower() != "shard"])
    placed = own.join(of, F.col(key).eqNullSafe(F.col("__key"))).drop("__key")  # rows without an id have a shard, too
    placed.repartition(F.col("shard")).write.partitionBy("shard").parquet(path)
    return assigned


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents").select("doc_id", "text"))


_SQL = f"""
WITH d AS (SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT CAST(least(greatest(ceil(log2(greatest(sum(n_bytes), 1) / {LIMIT}e0)), 0), {HASH_BITS}) AS BIGINT) AS d0 FROM d),
a AS (SELECT d.*, k AS depth, h >> ({HASH_BITS} - k) AS p, sum(n_bytes) OVER w AS shard_bytes, count(*) OVER w AS shard_rows,
    min(h) OVER w = max(h) OVER w AS alone
  FROM d, s, (SELECT unnest(range(0, {HASH_BITS} + 1)) AS k) r WHERE k <= d0 + 24 WINDOW w AS (PARTITION BY k, h >> ({HASH_BITS} - k))),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY depth) AS n FROM a WHERE shard_bytes <= {LIMIT} OR alone)
SELECT doc_id, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(p), CAST(depth AS INTEGER), '0') END AS shard, CAST(depth AS INTEGER) AS depth,
  n_bytes, CAST(shard_bytes AS BIGINT) AS shard_bytes, shard_rows, shard_bytes > {LIMIT} AS oversized
FROM f WHERE n = 1
"""
QUERIES = {"op10_sharding": op10_sharding}
ORACLES = {"op10_sharding": _SQL}
