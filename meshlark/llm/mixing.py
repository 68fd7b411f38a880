"""Mixing sources to target weights: iterative proportional fitting, then sampling by calibrated probabilities.

Documents are counted into cells of (source, language, topic); only the cells' token weights are raked, dimension after
dimension, until every marginal is within TOLERANCE of its target.  A cell's ratio of calibrated to actual weight, over
the largest ratio, is the probability with which each of its documents is kept, by a hash of its id: the mixture then
has the target marginals in expectation and no document is repeated.

With a budget (a share of all tokens), the scale is the budget in place of the largest ratio: after each round calibrated
weights are held to weight / budget, so that a small cell far below its target is kept whole and thins no other.  Targets
that this bound puts out of reach are missed, and the sample then holds less than the budget by what they lack.

Cases: null in a dimension is a value of its own; null or empty texts weigh nothing, and documents of cells without
weight are kept with the largest ratio, 1.  Repeated rows share their id's draw; a row without an id draws by its text.
mix replaces columns that have the names of its outputs; filter_documents keeps all columns as they are.  Targets that
can't all be met are warned of, with the deviation left.  An empty table gives an empty result.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlark.llm._common import apart, bounded, cut, materialize, table

#: A marginal's target shares are its actual shares to this power, rescaled (1: as they are, 0: uniform).
TEMPERS = {"source": 0.7, "lang": 0.8, "topic": 1.0}
ROUNDS = 20
TOLERANCE = 1e-12
NONE = "\x00none"


def n_tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def topic(tokens: Column) -> Column:
    """The topic of the queries, by length: notes, articles, reports, books."""
    return F.when(tokens < 100, "note").when(tokens < 400, "article").when(tokens < 2000, "report").otherwise("book")


def rake(cells: DataFrame, tempers: dict[str, float] = TEMPERS, rounds: int = ROUNDS, targets: dict[str, dict] | None = None, most: float | None = None) -> DataFrame:
    """cells (the dimensions and weight) with calibrated: weights whose marginals have the target shares.

    targets: by dimension and value, shares that replace the tempered ones.  most: calibrated weights are held to this
    multiple of the weight after each round.  Cells are few against documents, but their
    number isn't bounded, so each step is a shuffle of cells; nothing is collected but the largest deviation.
    """
    total = cells.agg(F.sum("weight").cast("double").alias("__total"))
    out = cells.crossJoin(F.broadcast(total)).withColumn("calibrated", F.col("weight").cast("double"))  # one row
    for d, power in tempers.items():
        given = (targets or {}).get(d)
        side = cells.groupBy(d).agg(F.sum("weight").cast("double").alias("__w")).where("__w > 0")
        if given is None:
            side = side.withColumn("__s", F.pow("__w", F.lit(float(power))))
        else:
            side = side.withColumn("__s", F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in given.items() for x in kv]), F.col(d)), F.lit(0.0)))
        norm = side.agg(F.sum("__s").alias("__n"))
        side = side.crossJoin(F.broadcast(norm)).select(d, (F.col("__s") / F.col("__n")).alias(f"__t_{d}"))
        out = out.join(side, d, "left")
    out = cut(out)
    for _ in range(rounds):
        for d in tempers:
            sums = out.groupBy(d).agg(F.sum("calibrated").alias("__m"))
            out = out.join(sums, d).withColumn("calibrated", F.when(F.col("__m") > 0, F.col("calibrated") * (F.col(f"__t_{d}") * F.col("__total") / F.col("__m"))).otherwise(F.lit(0.0))).drop("__m")
        if most is not None:
            out = out.withColumn("calibrated", F.least("calibrated", F.col("weight") * F.lit(float(most))))
        out = cut(out)
        if (left := off(out, tempers)) <= TOLERANCE:
            break
    else:
        warnings.warn(f"shares are off their targets by {left:.1e} at most after {rounds} rounds", stacklevel=2)
    return out.select(*tempers, "weight", "calibrated")


def off(cells: DataFrame, dims) -> float:
    """The largest distance of a marginal's share from its target."""
    each = [cells.groupBy(d).agg(F.abs(F.sum("calibrated") / F.max("__total") - F.coalesce(F.max(f"__t_{d}"), F.lit(0.0))).alias("__d")) for d in dims]
    both = each[0]
    for x in each[1:]:
        both = both.select("__d").unionByName(x.select("__d"))
    return both.agg(F.max("__d")).first()[0] or 0.0


def uniform(key: Column) -> Column:
    """A number in [0, 1) that depends on the key alone."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def mix(docs: DataFrame, dims: dict[str, Column], weight: Column, key: str = "doc_id", tempers: dict[str, float] = TEMPERS, rounds: int = ROUNDS, instead: Column | None = None, targets: dict[str, dict] | None = None, budget: float | None = None) -> DataFrame:
    """docs with the dimensions, weight, probability and kept.  targets: as of rake.

    budget: the share of all weight that the sample should hold (above 0, at most 1); None: as much as lets every cell
    have its ratio.

    Each row draws by its key, or by instead (the empty string if that is null, too) where it has none.
    """
    own = [c for c in docs.columns if c.lower() not in {*dims, "weight", "probability", "kept"} or c in dims]
    draw = uniform(F.coalesce(F.col(key).cast("string"), F.lit(None).cast("string") if instead is None else instead, F.lit("")))
    held = docs.select(*own, draw.alias("__draw")).withColumn("weight", weight).withColumns({d: F.coalesce(c.cast("string"), F.lit(NONE)) for d, c in dims.items()})
    cells = cut(held.groupBy(*dims).agg(F.sum("weight").alias("weight")))
    if budget is not None and not 0 < budget <= 1:
        raise ValueError(f"a budget is a share above 0 and at most 1, not {budget}")
    raked = rake(cells, tempers, rounds, targets, None if budget is None else 1 / budget).withColumn("__r", F.when(F.col("weight") > 0, F.col("calibrated") / F.col("weight")))
    top = raked.agg((F.max("__r") if budget is None else F.lit(1 / budget)).alias("__top"))
    odds = raked.crossJoin(F.broadcast(top)).select(*dims, F.coalesce(F.col("__r") / F.col("__top"), F.lit(1.0)).alias("probability"))
    return (
        held.join(bounded(materialize(odds)), list(dims))  # cells are few, so that texts needn't move
        .withColumn("kept", F.col("__draw") < F.col("probability"))
        .drop("__draw")
        .withColumns({d: F.when(F.col(d) != NONE, F.col(d)) for d in dims})
    )


def document_mixture(docs: DataFrame, budget: float | None = None) -> DataFrame:
    return mix(docs, {"source": F.col("source"), "lang": F.col("lang"), "topic": topic(n_tokens(F.col("text")))}, n_tokens(F.col("text")), instead=F.md5(F.col("text")), budget=budget)


def filter_documents(docs: DataFrame, budget: float | None = None) -> DataFrame:
    """The rows of docs that the mixture samples, with docs' own columns."""
    return apart(docs, ("doc_id", "text", "source", "lang"), lambda own: document_mixture(own, budget).where("kept"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    rounded = F.floor(F.col("probability") * 1e6 + 0.5) / 1e6
    return document_mixture(docs).select("doc_id", "source", "lang", "topic", F.col("weight").alias("n_tokens"), rounded.alias("probability"), "kept")


def mixing_sql(docs: str, tempers: dict[str, float] = TEMPERS, rounds: int = ROUNDS) -> str:
    """Common table expressions over a relation named by docs; the last is mx."""
    dims = list(tempers)
    out = [
        rf"""mx_d AS (SELECT doc_id, coalesce(source, chr(0) || 'none') AS source, coalesce(lang, chr(0) || 'none') AS lang, n AS weight,
  CASE WHEN n < 100 THEN 'note' WHEN n < 400 THEN 'article' WHEN n < 2000 THEN 'report' ELSE 'book' END AS topic
  FROM (SELECT doc_id, source, lang, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n FROM {docs}) q)""",
        "mx_c AS (SELECT source, lang, topic, CAST(sum(weight) AS DOUBLE) AS weight FROM mx_d GROUP BY ALL)",
        "mx_n AS (SELECT sum(weight) AS total FROM mx_c)",
    ]
    for d, power in tempers.items():
        out.append(f"mx_t_{d} AS (SELECT {d}, pow(sum(weight), {power!r}e0) AS s FROM mx_c GROUP BY {d} HAVING sum(weight) > 0)")
    last = "mx_c"
    step = 0
    for _ in range(rounds):
        for d in dims:
            step += 1
            source = "*" if step > 1 else "*, weight AS calibrated"
            out.append(f"""mx_{step} AS MATERIALIZED (SELECT c.source, c.lang, c.topic, c.weight,
  CASE WHEN m > 0 THEN c.calibrated * (t.s / (SELECT sum(s) FROM mx_t_{d}) * (SELECT total FROM mx_n) / m) ELSE 0e0 END AS calibrated
  FROM (SELECT *, sum(calibrated) OVER (PARTITION BY {d}) AS m FROM (SELECT {source} FROM {last}) q) c LEFT JOIN mx_t_{d} t ON c.{d} = t.{d})""")
            last = f"mx_{step}"
    out.append(f"mx_p AS (SELECT *, coalesce(r / (max(r) OVER ()), 1e0) AS probability FROM (SELECT *, CASE WHEN weight > 0 THEN calibrated / weight END AS r FROM {last}) q)")
    out.append("""mx AS (SELECT d.doc_id, nullif(d.source, chr(0) || 'none') AS source, nullif(d.lang, chr(0) || 'none') AS lang, d.topic, d.weight AS n_tokens,
  floor(probability * 1e6 + 0.5e0) / 1e6 AS probability,
  CAST(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656e0 < probability AS kept
  FROM mx_d d JOIN mx_p p ON d.source = p.source AND d.lang = p.lang AND d.topic = p.topic)""")
    return ",\n".join(out) + "\n"


QUERIES = {"op9_mixing": op9_mixing}
ORACLES = {"op9_mixing": "WITH " + mixing_sql("documents") + "SELECT * FROM mx"}
