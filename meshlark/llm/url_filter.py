"""URL filters: rules on hosts and paths, and for the rest words of host and path under naive Bayes.

Names without spaces (host labels, path words) are split by unigram Viterbi: the split into words with the largest
product of word frequencies, counted over the texts of all pages; what no word explains costs by its length.  Multinomial
naive Bayes then scores a url's words, those of the host and those of the path apart, as often as they occur.  It learns
from the urls that a rule decides and judges the others; words that no such url has say nothing.

Splitting works on distinct names: their substrings meet the word counts in a join, so neither the dictionary nor the
corpus is sent to a worker whole; only substrings as long as some word are laid out.  Classes are counted by distinct
name before words are, and scores are summed by distinct name and then by page.

Cases: a null url, or one without ://, has an empty host and path and no words: its verdict is allow, its score minus
infinity.  Without urls that a rule decides all scores are 0: allow.  Repeated rows are judged each.  Null html counts no
words.  The result has its own columns alone, so others of pages don't clash; an empty table stays empty.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlark.llm._common import materialize, spread, table

#: (rule, verdict): a host and a path; the rule fits the host and its subdomains if the url's path starts with its path.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))

SMOOTHING = 0.5
#: Share of all names of urls from which a name's odds are broadcast.
FREQUENT = 1 / 4096


def _rest(url: Column) -> Column:
    """What follows the first ://; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(_rest(url), r"\A([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct of rule and verdict; null if none does."""
    out = F.lit(None)
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def names(part: Column) -> Column:
    """The runs of letters of a host or path, lower-cased, as often as they occur; a run of digits is the name 0."""
    return F.regexp_extract_all(F.regexp_replace(F.lower(part), r"[0-9]+", "0"), F.lit(r"([a-z]+|0)"), F.lit(1))


def tokens_of(host: Column, path: Column) -> Column:
    """The names of a url, each with its part: h of the host, p of the path."""
    return F.concat(
        F.transform(names(host), lambda x: F.struct(F.lit("h").alias("part"), x.alias("name"))),
        F.transform(names(path), lambda x: F.struct(F.lit("p").alias("part"), x.alias("name"))),
    )


def word_counts(pages: DataFrame) -> DataFrame:
    """(word, count) over the texts of all pages, without tags."""
    text = F.regexp_replace(F.coalesce(F.col("html"), F.lit("")), r"(?s)<(?:script|style)\b.*?</|<[^>]*>|&[a-z]+;", " ")
    return pages.select(F.explode(F.split(F.lower(text), "[^a-z]+")).alias("word")).where("word != ''").groupBy("word").count()


def viterbi(name: str, score: dict[str, float], unknown: float) -> list[str]:
    """The best split of a name; a piece that is no word costs unknown plus a tenfold for each letter."""
    n, ten = len(name), math.log(10)
    sizes = sorted({len(w) for w in score})
    best, came = [0.0] + [-math.inf] * n, [0] * (n + 1)
    ahead, start_of = 0.0, 0  # of the starts so far, the best for a piece that is no word: best[start] + start * ten
    for end in range(1, n + 1):
        best[end], came[end] = ahead + unknown - end * ten, start_of
        for size in sizes:
            if size > end:
                break
            found = score.get(name[end - size : end])
            if found is not None and best[end - size] + found >= best[end]:
                best[end], came[end] = best[end - size] + found, end - size
        if best[end] + end * ten > ahead:
            ahead, start_of = best[end] + end * ten, end
    out, end = [], n
    while end:
        out.append(name[came[end] : end])
        end = came[end]
    return out[::-1]


def segment(distinct: DataFrame, counts: DataFrame) -> DataFrame:
    """(name, words) of distinct names (name), by the counts of words (word, count), a written table."""
    longest = distinct.agg(F.coalesce(F.max(F.length("name")), F.lit(0)).alias("longest"))
    sized = counts.withColumn("size", F.length("word"))
    lengths = sized.crossJoin(F.broadcast(longest)).where("size <= longest").agg(F.array_sort(F.collect_set("size")).alias("sizes"))  # as many as the longest name's letters
    total = counts.agg(F.greatest(F.sum("count"), F.lit(1)).cast("double").alias("total"))
    both = F.broadcast(materialize(total.crossJoin(lengths)))  # one row
    # every substring of a name that is as long as some word, with its count where it is a word
    starts = lambda k: F.transform(F.sequence(F.lit(1), F.length("name") - k + 1), lambda i: F.substring(F.col("name"), i, k))
    parts = F.flatten(F.transform(F.filter("sizes", lambda k: k <= F.length("name")), starts))
    pieces = distinct.where("name != ''").crossJoin(both).select("name", F.explode(F.array_distinct(parts)).alias("word"))
    known = pieces.join(counts, "word").groupBy("name").agg(F.collect_list(F.struct("word", "count")).alias("known"))
    known = distinct.join(known, "name", "left").crossJoin(both)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            name, found, total = (batch.column(c).to_pylist() for c in ("name", "known", "total"))
            words = [viterbi(x, {w["word"]: math.log(w["count"] / t) for w in k or ()}, math.log(10.0 / t)) for x, k, t in zip(name, found, total, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(words, pa.list_(pa.string()))], ["name", "words"])

    return known.select("name", "known", "total").mapInArrow(run, "name string, words array<string>")


def token_odds(tokens: DataFrame) -> DataFrame:
    """(part, word, odds) of tokens (part, word, nb, na), counts in examples to block and to allow: multinomial, smoothed."""
    total = tokens.agg(F.sum("nb").alias("b"), F.sum("na").alias("a"), F.count(F.lit(1)).alias("v"))
    smooth = lambda n, t: F.log((F.col(n) + SMOOTHING) / (F.col(t) + SMOOTHING * F.col("v")))
    return tokens.crossJoin(F.broadcast(total)).select("part", "word", (smooth("nb", "b") - smooth("na", "a")).alias("odds"))  # one row


def with_odds(rows: DataFrame, odds: DataFrame) -> DataFrame:
    """rows (row, part, name) with odds (part, name, n, odds), n being the name's number of rows.

    Names that FREQUENT or a larger share of the rows have are 1 / FREQUENT at most, so they are broadcast; the join of
    the others has no key of more rows than that share.
    """
    all_rows = odds.agg(F.sum("n")).first()[0] or 0
    often = F.broadcast(odds.where(F.col("n") >= FREQUENT * all_rows).select("part", "name", "odds"))
    met = rows.join(often, ["part", "name"], "left")
    rare = odds.where(F.col("n") < FREQUENT * all_rows).select("part", "name", F.col("odds").alias("own"))
    others = met.where("odds IS NULL").drop("odds").join(rare, ["part", "name"])
    return met.where("odds IS NOT NULL").select("row", "odds").unionByName(others.select("row", F.col("own").alias("odds")))


def judge(pages: DataFrame, key: str = "page_id", rules=RULES) -> DataFrame:
    """(key, host, path, rule, verdict, score); score is the log odds of block of the words of host and path."""
    urls = pages.select(F.monotonically_increasing_id().alias("row"), F.col(key), "url")
    urls = urls.select("row", key, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    urls = urls.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    urls = materialize(urls.withColumn("names", tokens_of(F.col("host"), F.col("path"))))
    block = F.col("fit.verdict") == "block"  # null where no rule decides
    rows = urls.select("row", block.alias("block"), F.inline("names"))
    tally = rows.groupBy("part", "name").agg(F.count(F.lit(1)).alias("n"), F.count_if("block").alias("nb"), F.count_if(~F.col("block")).alias("na"))
    tally = materialize(tally)
    split = materialize(segment(spread(tally.select("name").distinct(), "name"), materialize(word_counts(pages))))

    words = tally.join(split, "name").select("part", "name", "n", "nb", "na", F.explode("words").alias("word"))
    words = materialize(words)
    tokens = words.groupBy("part", "word").agg(F.sum("nb").alias("nb"), F.sum("na").alias("na")).where("nb + na > 0")
    of_name = words.join(token_odds(materialize(tokens)), ["part", "word"]).groupBy("part", "name").agg(F.max("n").alias("n"), F.sum("odds").alias("odds"))
    score = with_odds(rows.select("row", "part", "name"), materialize(of_name)).groupBy("row").agg(F.sum("odds").alias("score"))
    prior = urls.agg(F.log((F.count_if(block) + 1) / (F.count_if(~block) + 1)).alias("prior"))
    out = urls.join(score, "row", "left").crossJoin(F.broadcast(prior))  # one row
    score = F.when(F.size("names") > 0, F.coalesce("score", F.lit(0.0)) + F.col("prior")).otherwise(F.lit(float("-inf")))
    return out.select(
        key, "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce("fit.verdict", F.when(score > 0, "block").otherwise("allow")).alias("verdict"), score.alias("score"),
    )


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


QUERIES = {"op1_url_filter": op1_url_filter}
ORACLES: dict[str, str] = {}
