"""Helpers shared by the operators of this subpackage: tables, lineage cuts, byte-level word scanning."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than space and U+0009..U+000D.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a temporary one only where Spark runs in one JVM."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    held = spark.sparkContext.getCheckpointDir()
    if held is None:
        if named is None and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return named or spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the checkpoint folder, from which any executor can read it again."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialize(df: DataFrame) -> DataFrame:
    """Like cut, as a Parquet table: columnar and compressed, for what is wide.  It is deleted when the driver ends."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.parquet(path)


def apart(docs: DataFrame, needed: tuple[str, ...], run) -> DataFrame:
    """run(docs of the needed columns alone) with docs' columns: the others travel in one struct, whatever their names."""
    quoted = lambda c: "`" + c.replace("`", "``") + "`"
    rest = [c for c in docs.columns if c not in needed]
    own = [c for c in docs.columns if c in needed]
    out = run(docs.select(*own, F.struct(*([F.col(quoted(c)) for c in rest] or [F.lit(True)])).alias("__rest")))
    return out.select(*[F.col(c) if c in own else F.col("__rest").getField(c).alias(c) for c in docs.columns])


#: Rows of narrow tables (64 bytes at most) that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1 << 20


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, a written or checkpointed table of narrow rows, to be broadcast if its counted size allows."""
    return F.broadcast(df) if df.count() <= rows else df


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), F.lit(1))


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, though body uses it within lambda functions."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def spread(df: DataFrame, *cols) -> DataFrame:
    return df.repartition(shuffle_partitions(df.sparkSession), *cols)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def input_partitions(df: DataFrame) -> int:
    """Number of partitions in which df is read: it follows the size of the input."""
    return max(df.rdd.getNumPartitions(), 1)


# ---- words of a batch of texts, as arrays -----------------------------------------------------------------------------

_MASK = (1 << 64) - 1
_STEP = 0x9E3779B97F4A7C15
_POWER = 0xD6E8FEB86659FD93  # odd, so that its powers can be divided by modulo 2**64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_STEP))


_HELD: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0, base**1, ... modulo 2**64, n of them; kept for the next call."""
    if len(held := _HELD.get(base, ())) < n:
        held = np.full(n, base, dtype=np.uint64)
        held[0] = 1
        held = _HELD[base] = np.multiply.accumulate(held)
    return held[:n]


def portions(batch: pa.RecordBatch, column: int, rows: int = 256, size: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """batch in slices of at most so many rows and bytes of a string column; a longer text is a slice of its own."""
    length = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    end = np.concatenate([[0], np.cumsum(length, dtype=np.int64)])
    at = 0
    while at < batch.num_rows:
        last = max(int(np.searchsorted(end, end[at] + size, side="right")) - 1, at + 1)
        last = min(last, at + rows, batch.num_rows)
        yield batch.slice(at, last - at)
        at = last


class Words:
    """Hashes of the words of texts: hash[doc_start[d]:doc_start[d + 1]] belong to text d."""

    def __init__(self, hashes: np.ndarray, doc: np.ndarray, doc_start: np.ndarray):
        self.hash, self.doc, self.doc_start = hashes, doc, doc_start


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column on end, and where each row starts (null: empty)."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset:]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def scan_words(raw: np.ndarray, starts: np.ndarray, lower: bool, block: int = 1 << 17) -> Words:
    """Words of texts by one pass over their bytes.

    Each word gets the 64-bit polynomial hash of its bytes, mixed.  Equal words have equal hashes; unequal ones
    collide with probability about 2**-64 a pair.  Memory is a small multiple of the block, which ends at a text's end.
    """
    n_docs, parts, counts = len(starts) - 1, [], []
    first = 0
    while first < n_docs:
        last = max(int(np.searchsorted(starts, starts[first] + block, side="right")) - 1, first + 1)
        piece = raw[starts[first] : starts[last]]
        hashes, at = _scan(piece, starts[first : last + 1] - starts[first], lower)
        parts.append(hashes)
        counts.append(at)
        first = last
    per_doc = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    doc_start = np.concatenate([[0], np.cumsum(per_doc)]).astype(np.int64)
    hashes = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return Words(hashes, np.repeat(np.arange(n_docs), per_doc), doc_start)


def _scan(raw: np.ndarray, starts: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, and their number in each text."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(starts) - 1, np.int64)
    if lower:
        raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw)
    inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edge = np.zeros(n + 1, bool)  # a text's first byte never continues the last text's word
    edge[starts[(starts < n)]] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:n]
    begin, end = np.flatnonzero(begin), np.flatnonzero(end)
    power = _powers(_POWER, n)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * power, dtype=np.uint64)])
    back = _powers(pow(_POWER, -1, 1 << 64), n)
    hashes = mix((total[end + 1] - total[begin]) * back[begin] + (end - begin).astype(np.uint64))
    return hashes, np.diff(np.searchsorted(begin, starts))
