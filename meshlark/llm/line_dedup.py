"""Line dedup by a deletion-neighbourhood join: native DataFrame operations only.

A line with a word goes if it is a later copy of a line, or if some line that first occurs earlier is within one edit
(insertion, deletion or substitution of a character).  The bound is one edit for each NEAR_CHARS characters, one at most:
of shorter lines an edit is over a tenth, so only their copies go.  Earlier: by (id, hash of text, line number).

Equal lines are one line from the start.  Emitting a line's whole neighbourhood (the line without each of its
characters) costs as many keys as it has characters, so the neighbourhood is narrowed first, which loses nothing: an edit
lies within one block of the line, and the line without that block is equal in both.

  level 0   the line without one of its halves, as hashed keys; lines that share no key have no partner
  level 1   for the rest: the half without one of its eight blocks
  level 2   for the rest: the block without each of its characters

A longer line's keys are laid out once by its own length and once by the length less one, so that they meet a shorter
partner's.  Level 2's keys hold the position of a substituted character (all lines that share one are within one edit of
each other), or join a longer line to the one shorter line that is its variant.  So comparing each line with the earliest
partner of its key finds whether it has an earlier partner: no pairs within a group are emitted.  Partners are verified
by Levenshtein distance on the texts.

Cases: null texts stay null, empty ones empty.  Lines without a word stay.  Repeated rows (same id, same text) are the
same occurrence and keep the same lines.  Null ids come first.  A text of n characters costs n.  dedup_lines replaces
columns named n_lines or n_dropped; filter_documents keeps all columns as they are.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlark.llm._common import WORD, apart, bounded, materialize, table

#: Characters of a line for each edit within which it is a near copy; one edit is looked for.
NEAR_CHARS = 10
BLOCKS = 8

LINE = ("h1", "h2")


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.lit("text"), text)


def occurrences(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, th, no, line, n, h1, h2): each line with a word of each document."""
    lines = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("id"), _text_hash(F.col(text)).alias("th"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("no", "line"))
    return lines.withColumn("n", F.length("line")).where(F.col("line").rlike(WORD)).withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit("second"), "line")})


def _sub(line: Column, start: Column, length: Column) -> Column:
    """length characters from start, counted from 0."""
    return F.substring(line, start + 1, F.greatest(length, F.lit(0)))


def _halves(line: Column, n: Column) -> Column:
    """The keys of level 0: (k, m, b) for the layouts of m = n and n - 1 characters without half b."""
    out = []
    for less in (0, 1):
        m = n - less
        half = F.floor(m / 2).cast("int")
        out.append(F.struct(F.xxhash64(m, F.lit(0), F.right(line, m - half)).alias("k"), m.alias("m"), F.lit(0).alias("b")))
        out.append(F.struct(F.xxhash64(m, F.lit(1), F.left(line, half)).alias("k"), m.alias("m"), F.lit(1).alias("b")))
    return F.array(*out)


def shared(keyed: DataFrame, key: str) -> DataFrame:
    """The rows of keyed whose key two or more rows have."""
    twice = materialize(keyed.groupBy(key).agg(F.count(F.lit(1)).alias("__c")).where("__c > 1").select(key))
    return keyed.join(bounded(twice), key)


def near_lines(docs: DataFrame, distinct: DataFrame, key: str, text: str) -> DataFrame:
    """(h1, h2) of the distinct lines (first, n, keys) that have an earlier line within one edit."""
    halves = distinct.select(*LINE, "first", F.inline("keys"))
    halves = materialize(shared(halves, "k"))
    # the texts of the few lines that are left
    wanted = materialize(halves.select(*LINE, "first").distinct())
    homes = materialize(wanted.select("first.id", "first.th").distinct())
    own = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), _text_hash(F.col(text)).alias("th")).where("text IS NOT NULL").alias("d")
    homes = bounded(homes).alias("h")
    held = own.join(homes, F.col("d.id").eqNullSafe(F.col("h.id")) & (F.col("d.th") == F.col("h.th")), "left_semi")
    lines = occurrences(held, "id", "text").select(*LINE, "line", "n").join(bounded(wanted), list(LINE))
    lines = materialize(lines.groupBy(*LINE).agg(F.first("line").alias("line"), F.first("n").alias("n"), F.first("first").alias("first")))

    at = halves.drop("first").join(lines, list(LINE)).withColumns({
        "from": F.when(F.col("b") == 0, 0).otherwise(F.floor(F.col("m") / 2)).cast("int"),
        "to": F.when(F.col("b") == 0, F.floor(F.col("m") / 2)).otherwise(F.col("m")).cast("int"),
        "extra": F.col("n") - F.col("m"),
    })
    blocks = F.transform(
        F.sequence(F.lit(0), F.lit(BLOCKS - 1)),
        lambda s: F.struct(
            s.alias("s"),
            (F.col("from") + F.floor((F.col("to") - F.col("from")) * s / BLOCKS)).cast("int").alias("p"),
            (F.col("from") + F.floor((F.col("to") - F.col("from")) * (s + 1) / BLOCKS)).cast("int").alias("q"),
        ),
    )
    at = at.withColumn("o", F.explode(blocks)).select(*LINE, "line", "n", "first", "k", "from", "to", "extra", "o.s", "o.p", "o.q")
    ahead = _sub(F.col("line"), F.col("from"), F.col("p") - F.col("from"))
    behind = _sub(F.col("line"), F.col("q") + F.col("extra"), F.col("to") - F.col("q"))
    level1 = materialize(at.withColumn("k1", F.xxhash64("k", "s", ahead, F.lit("|"), behind)).select(*LINE, "first", "extra", "k1", _sub(F.col("line"), F.col("p"), F.col("q") - F.col("p") + F.col("extra")).alias("part")))
    level1 = shared(level1, "k1")

    size = F.length("part")
    without = lambda i: F.concat(F.left("part", i - 1), F.right("part", size - i))
    places = F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>"))
    same = F.transform(places, lambda i: F.struct(F.xxhash64(F.lit("s"), "k1", i, without(i)).alias("v"), F.lit(0).alias("role")))
    longer = F.transform(places, lambda i: F.struct(F.xxhash64(F.lit("d"), "k1", without(i)).alias("v"), F.lit(1).alias("role")))
    shorter = F.array(F.struct(F.xxhash64(F.lit("d"), "k1", "part").alias("v"), F.lit(2).alias("role")))
    variants = level1.select(*LINE, "first", F.inline(F.when(F.col("extra") == 1, longer).otherwise(F.concat(same, shorter))))
    variants = materialize(variants.distinct())
    best = lambda role: F.min(F.when(F.col("role") == role, F.struct("first", *LINE)))
    found = variants.groupBy("v").agg(best(0).alias("same"), best(1).alias("longer"), best(2).alias("shorter"), F.count(F.lit(1)).alias("__c")).where("__c > 1")
    partner = F.when(F.col("role") == 0, F.col("same")).when(F.col("role") == 1, F.col("shorter")).otherwise(F.col("longer"))
    pairs = variants.join(found, "v").withColumn("other", partner).where("other.first < first").select(*LINE, F.col("other.h1").alias("o1"), F.col("other.h2").alias("o2")).distinct()
    one = lines.select(*LINE, F.col("line").alias("a"))
    two = lines.select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.col("line").alias("z"))
    verified = pairs.join(one, list(LINE)).join(two, ["o1", "o2"]).where(F.levenshtein("a", "z", 1) >= 0)
    return verified.select(*LINE).distinct()


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", near_chars: int = NEAR_CHARS) -> DataFrame:
    """docs with text without the lines that go, n_lines and n_dropped (long)."""
    held = docs.drop(*[c for c in docs.columns if c.lower() in ("n_lines", "n_dropped")])
    lines = occurrences(held, key, text)
    keyed = lines.withColumn("keys", _halves(F.col("line"), F.col("n")))
    distinct = materialize(
        keyed.select(*LINE, F.struct("id", "th", "no").alias("at"), *[F.col("keys")[i]["k"].alias(f"k{i}") for i in range(4)], "n")
        .groupBy(*LINE)
        .agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("copies"), F.min("n").alias("n"), *[F.min(f"k{i}").alias(f"k{i}") for i in range(4)])
    )
    keys = F.array(*[F.struct(F.col(f"k{i}").alias("k"), (F.col("n") - i // 2).alias("m"), F.lit(i % 2).alias("b")) for i in range(4)])
    long = distinct.where(F.col("n") >= near_chars)
    near = materialize(near_lines(held, long.select(*LINE, "first", "n", keys.alias("keys")), key, text).withColumn("near", F.lit(True)))
    doubtful = distinct.select(*LINE, "first", "copies").join(bounded(near), list(LINE), "left").where("copies > 1 OR near")
    gone = lines.select("id", "th", "no", *LINE).join(doubtful, list(LINE)).where(F.col("near").isNotNull() | (F.struct("id", "th", "no") != F.col("first")))
    gone = gone.groupBy(F.col("id").alias("__id"), F.col("th").alias("__th")).agg(F.collect_set("no").alias("__gone"))
    out = held.withColumn("__own", _text_hash(F.col(text))).join(gone, F.col(key).eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__th")), "left")
    parts = F.split(F.col(text), "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("__gone"))
    out = out.withColumn("__parts", parts).withColumns({
        "n_lines": F.coalesce(F.size("__parts"), F.lit(0)).cast("long"),
        "n_dropped": F.coalesce(F.size("__gone"), F.lit(0)).cast("long"),
        text: F.when(F.col("__gone").isNull(), F.col(text)).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col("__parts"), i)), "\n")),
    })
    return out.select(*held.columns, "n_lines", "n_dropped")


def filter_documents(docs: DataFrame) -> DataFrame:
    """docs with the lines that stay and n_chars to match; a document of which no word is left goes."""

    def run(own: DataFrame) -> DataFrame:
        out = dedup_lines(own).where((F.col("n_dropped") == 0) | F.col("text").rlike(WORD))
        if "n_chars" in own.columns:
            out = out.withColumn("n_chars", F.when(F.col("n_dropped") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long")))
        return out

    return apart(docs, ("doc_id", "text", "n_chars"), run)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def lines_sql(docs: str) -> str:
    """Common table expressions over a relation named by docs; the last is ld (doc_id, text, n_lines, n_dropped)."""
    return rf"""
ld_l AS (SELECT doc_id, l, i - 1 AS no FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM {docs}) q),
ld_f AS (SELECT l, min((doc_id, no)) AS f, length(l) AS n FROM ld_l WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY l),
ld_n AS (SELECT DISTINCT a.l FROM ld_f a JOIN ld_f b ON b.n BETWEEN a.n - 1 AND a.n + 1 AND a.n >= {NEAR_CHARS} AND b.n >= {NEAR_CHARS} AND b.f < a.f AND levenshtein(a.l, b.l) <= 1),
ld_k AS (SELECT x.doc_id, x.no, x.l, (f.l IS NULL OR ((x.doc_id, x.no) = f.f AND f.l NOT IN (SELECT l FROM ld_n))) AS kept FROM ld_l x LEFT JOIN ld_f f ON x.l = f.l),
ld AS (SELECT doc_id, coalesce(string_agg(l, chr(10) ORDER BY no) FILTER (kept), '') AS text, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (NOT kept) AS BIGINT) AS n_dropped FROM ld_k GROUP BY doc_id)
"""


QUERIES = {"op7_line_dedup": op7_line_dedup}
ORACLES = {"op7_line_dedup": "WITH " + lines_sql("documents") + "SELECT * FROM ld"}
