"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

Every document gets counts of its whole text (words, characters, symbols, stop words, lines) in one projection, and a
verdict from RULES, each a linear inequality in these counts, so that both sides stay integers and no division can fail.

Cases: a null or empty text, or one without words, has zero counts and fails the base rule (under 50 words).  Null ids,
sources or languages pass through.  Repeated rows are judged each by itself.  measure and judge replace columns that have
the names of their outputs; filter_documents keeps all columns as they are.  An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlark.llm._common import SPACE, WORD, apart, let, table, words

# Function words of four languages.
STOP_WORDS = (
    "the be to of and that have with this for from are was is in it "
    "le la les de des et un une est que dans pour "
    "der die das und ist von zu den mit ein "
    "el los las en y por con para se del"
).split()

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """at_least or at_most: scale * metric against times * of (a metric, or 1 for a constant)."""

    name: str
    metric: str
    kind: str
    times: int
    of: str = "one"
    scale: int = 1

    def passes(self) -> str:
        sign = {"at_least": ">=", "at_most": "<="}[self.kind]
        return f"{self.scale} * {self.metric} {sign} {self.times} * {self.of}".replace("* one", "* 1")


RULES = (
    Rule("enough_words", "n_words", "at_least", 50),
    Rule("word_length_low", "word_chars", "at_least", 2, "n_words"),
    Rule("word_length_high", "word_chars", "at_most", 12, "n_words"),
    Rule("symbols_per_word", "n_symbols", "at_most", 25, "n_words", 100),
    Rule("stop_words", "n_stop_words", "at_least", 2),
    Rule("stop_word_ratio", "n_stop_words", "at_least", 2, "n_words", 100),
    Rule("duplicate_lines", "n_dup_lines", "at_most", 50, "n_lines", 100),
    Rule("ellipsis_lines", "n_ellipsis_lines", "at_most", 30, "n_lines", 100),
    Rule("bullet_lines", "n_bullet_lines", "at_most", 90, "n_lines", 100),
)
METRICS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines",
    "n_ellipsis_lines", "n_bullet_lines",
)


def _repeat_words(w: Column) -> Column:
    """Words within three-word windows that occur twice or more.

    Windows are compared by 64-bit hashes; a text's windows are sorted, so the cost is n log n however often they repeat.
    """
    n = F.greatest(F.size(w) - 2, F.lit(0))
    hashes = F.transform(F.slice(w, F.lit(1), n), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1), x + 3) - x))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    def repeated(s: Column) -> Column:
        twins = F.filter(s, lambda x, i: x["h"].eqNullSafe(F.get(s, i - 1)["h"]) | x["h"].eqNullSafe(F.get(s, i + 1)["h"]))
        return let(F.array_sort(F.transform(twins, lambda x: x["i"])), covered)

    def by_sorting(h: Column) -> Column:
        return let(F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), repeated)

    def by_lookup(h: Column, twice: Column) -> Column:
        at = F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(twice, x), i)), lambda x: x.isNotNull())
        return let(at, covered)

    def count(h: Column, twice: Column) -> Column:  # both ways give the same; a lookup in few hashes is the faster
        return F.when(F.size(twice) == 0, 0).when(F.size(twice) <= 24, by_lookup(h, twice)).otherwise(by_sorting(h))

    def twice(h: Column) -> Column:
        found = let(F.sort_array(h), lambda s: F.array_distinct(F.filter(s, lambda x, i: x == F.get(s, i - 1))))
        return let(found, lambda t: count(h, t))

    return let(hashes, twice)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the columns of METRICS (long)."""
    t = F.coalesce(F.col(text), F.lit(""))
    stop = STOP_WORDS

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(*stop))).cast("long").alias("n_stop_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeat_words(w).cast("long").alias("n_repeat_words"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            F.size(F.filter(lines, lambda x: x.rlike(rf"(\.\.\.|…){SPACE}*$"))).cast("long").alias("n_ellipsis_lines"),
            F.size(F.filter(lines, lambda x: x.rlike(rf"^{SPACE}*[-*•]"))).cast("long").alias("n_bullet_lines"),
        )

    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))
    held = docs.drop(*[c for c in docs.columns if c.lower() in {*METRICS, "__w", "__l"}])
    out = held.withColumns({
        "__w": let(words(F.col(text)), of_words),
        "__l": let(lines, of_lines),
        "n_symbols": F.length(F.regexp_replace(t, "[^#*$%&|<>]+", "")).cast("long"),
    })
    flat = {c: F.col("__w")[c] for c in ("n_words", "word_chars", "n_stop_words", "n_repeat_words")}
    flat |= {c: F.col("__l")[c] for c in ("n_lines", "n_dup_lines", "n_ellipsis_lines", "n_bullet_lines")}
    return out.withColumns(flat).drop("__w", "__l")


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with METRICS, base_failed and kept (booleans), and failed (the names of the rules that it breaks)."""
    out = measure(docs, text)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    broken = [F.when(~F.expr(r.passes()), F.lit(r.name)) for r in rules]
    kept = reduce(lambda a, b: a & b, [F.expr(r.passes()) for r in rules], ~base)
    return out.withColumns({"base_failed": base, "kept": kept, "failed": F.array_compact(F.array(*broken))})


def filter_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that the rules keep, with docs' own columns."""
    return apart(docs, (text,), lambda own: judge(own, text).where("kept"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs).select("doc_id", *METRICS, "base_failed", "kept")


_STOP_SQL = ", ".join(f"'{w}'" for w in STOP_WORDS)
_KEPT_SQL = " AND ".join(f"({r.passes()})" for r in RULES)
#: Counts of each text and the verdict, as common table expressions over a relation named by docs.
RULES_SQL = r"""
qr_w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM {docs}),
qr_x AS (SELECT doc_id, t, w, CASE WHEN len(w) < 3 THEN [] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || chr(10) || w[i+1] || chr(10) || w[i+2]) END AS g,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM qr_w),
qr_e AS (SELECT doc_id, unnest(g) AS g, unnest(range(1, len(g) + 1)) AS i FROM qr_x),
qr_d AS (SELECT doc_id, i FROM qr_e QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
qr_r AS (SELECT doc_id, CAST(count(DISTINCT i + d) AS BIGINT) AS n_repeat_words FROM qr_d, (SELECT unnest([0, 1, 2]) AS d) o GROUP BY doc_id),
qr_m AS (SELECT x.doc_id,
    CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(list_filter(w, lambda y: lower(y) IN ({stop}))) AS BIGINT) AS n_stop_words,
    CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(list_filter(lines, lambda y: regexp_matches(y, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS BIGINT) AS n_ellipsis_lines,
    CAST(len(list_filter(lines, lambda y: regexp_matches(y, '^[\x20\x09-\x0D]*[-*•]'))) AS BIGINT) AS n_bullet_lines
  FROM qr_x x LEFT JOIN qr_r r ON x.doc_id = r.doc_id),
qr_j AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM qr_m),
qr AS (SELECT *, (NOT base_failed AND {kept}) AS kept FROM qr_j)
"""


def rules_sql(docs: str) -> str:
    return RULES_SQL.replace("{docs}", docs).replace("{stop}", _STOP_SQL).replace("{kept}", _KEPT_SQL)


QUERIES = {"op4_quality_rules": op4_quality_rules}
ORACLES = {"op4_quality_rules": "WITH " + rules_sql("documents") + "SELECT doc_id, " + ", ".join(METRICS) + ", base_failed, kept FROM qr"}
