import re
import warnings

import pytest
from pyspark.sql import functions as F

from meshlark.llm import mixing as X


def shares(rows, d, value):
    total = sum(r[value] for r in rows)
    out = {}
    for r in rows:
        out[r[d]] = out.get(r[d], 0) + r[value] / total
    return out


def test_marginals_reach_their_targets(spark):
    cells = [(s, g, t, 1 + (7 * i + 3 * j + 11 * k) % 13) for i, s in enumerate("abc") for j, g in enumerate(["en", "de"]) for k, t in enumerate("xyz")]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, weight long")
    rows = X.rake(df, rounds=40).collect()
    for d, power in X.TEMPERS.items():
        own, got = shares(rows, d, "weight"), shares(rows, d, "calibrated")
        norm = sum(v**power for v in own.values())
        assert all(abs(got[k] - own[k] ** power / norm) < 1e-9 for k in own)


def test_given_targets(spark):
    df = spark.createDataFrame([("a", "en", "x", 90), ("a", "de", "x", 10), ("b", "en", "x", 50), ("b", "de", "x", 50)], "source string, lang string, topic string, weight long")
    got = shares(X.rake(df, {"source": 1.0, "lang": 1.0}, 60, {"lang": {"en": 0.5, "de": 0.5}}).collect(), "lang", "calibrated")
    assert abs(got["en"] - 0.5) < 1e-9


def test_sample_follows_probabilities(spark):
    df = spark.range(20000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "big").otherwise(F.concat(F.lit("s"), F.col("id") % 6)).alias("source"), F.lit("en").alias("lang"), F.lit("one two three").alias("text"))
    rows = X.document_mixture(df).groupBy("source").agg(F.avg("probability").alias("p"), F.avg(F.col("kept").cast("int")).alias("kept"), F.count("*").alias("n")).collect()
    assert len(rows) == 3 and all(abs(r["p"] - r["kept"]) < 4 * (0.25 / r["n"]) ** 0.5 for r in rows)
    assert max(r["p"] for r in rows) > 1 - 1e-9 and min(r["p"] for r in rows) < 0.9


def test_awkward_rows(awkward, nothing, clashing):
    docs = clashing(awkward)
    rows = X.document_mixture(docs).collect()
    assert len(rows) == awkward.count() and all(0 <= r["probability"] <= 1 for r in rows)
    kept = X.filter_documents(docs)
    assert kept.columns == docs.columns and {(r["topic"], r["weight"], r["kept"]) for r in kept.collect()} == {(7, 7, 7)}
    assert X.document_mixture(nothing).count() == 0
    assert not re.search("Python|Pandas|Arrow", X.document_mixture(awkward)._jdf.queryExecution().executedPlan().toString())


def test_rows_without_an_id_are_drawn(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 2 > 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 > 0, "big").otherwise("small").alias("source"), F.lit("en").alias("lang"), F.concat(F.lit("one two "), F.col("id")).alias("text"))
    rows = X.document_mixture(df).where("doc_id IS NULL").groupBy("source").agg(F.avg("probability").alias("p"), F.avg(F.col("kept").cast("int")).alias("kept"), F.count("kept").alias("n"), F.count("*").alias("all")).collect()
    assert len(rows) == 2 and all(r["n"] == r["all"] and abs(r["p"] - r["kept"]) < 4 * (0.25 / r["n"]) ** 0.5 for r in rows)
    assert X.filter_documents(df).where("doc_id IS NULL").count() == sum(round(r["kept"] * r["n"]) for r in rows)


def bounded_raking(cells, budget):
    """Probabilities by cell, from numbers in dicts."""
    total, now = sum(cells.values()), {c: float(w) for c, w in cells.items()}
    share = lambda of, d: {v: sum(w for c, w in of.items() if c[d] == v) for v in {c[d] for c in of}}
    for _ in range(X.ROUNDS):
        for d, power in enumerate(X.TEMPERS.values()):
            want, have = {v: w**power for v, w in share(cells, d).items()}, share(now, d)
            now = {c: w * want[c[d]] / sum(want.values()) * total / have[c[d]] for c, w in now.items()}
        now = {c: min(w, cells[c] / budget) for c, w in now.items()}
    return {c: budget * w / cells[c] for c, w in now.items()}


def with_a_rare_source(spark, n=2000):
    rows = [(i, "abc"[i % 7 % 3], "en" if i % 5 else "de", "one two three " * (1 + i % 60)) for i in range(n)]
    return spark.createDataFrame([*rows, (n, "rare", "en", "only these four words")], "doc_id long, source string, lang string, text string")


@pytest.mark.parametrize("budget", [0.5, 0.9])
def test_budget_against_plain_raking(spark, budget):
    df = with_a_rare_source(spark)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        rows = X.document_mixture(df, budget).collect()
    cells = {}
    for r in rows:
        c = r["source"], r["lang"], r["topic"]
        cells[c] = cells.get(c, 0) + r["weight"]
    want = bounded_raking(cells, budget)
    assert all(abs(r["probability"] - want[r["source"], r["lang"], r["topic"]]) < 1e-9 for r in rows)
    share = sum(r["probability"] * r["weight"] for r in rows) / sum(cells.values())
    assert share < budget + 1e-9 and (budget == 0.9 or share > budget - 1e-3)  # of "de" there is less than 0.9 asks for


def test_a_rare_source_is_kept_whole_and_thins_no_other(spark):
    df = with_a_rare_source(spark)
    with pytest.warns(UserWarning, match="off their targets"):
        budgeted = {r["source"]: r for r in X.document_mixture(df, 0.8).groupBy("source").agg(F.min("probability").alias("p"), F.min("kept").alias("kept")).collect()}
    assert budgeted["rare"]["p"] > 1 - 1e-9 and budgeted["rare"]["kept"]
    assert all(budgeted[s]["p"] > 0.5 for s in "abc")
    assert X.document_mixture(df).where("source = 'a'").agg(F.max("probability")).first()[0] < 0.5
    with pytest.raises(ValueError):
        X.document_mixture(df, 1.5)


def test_budget_of_awkward_rows(awkward, nothing, clashing):
    docs = clashing(awkward)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        rows = X.document_mixture(docs, 0.7).collect()
        kept = X.filter_documents(docs, 0.7)
    assert len(rows) == awkward.count() and all(0 <= r["probability"] <= 1 and r["kept"] is not None for r in rows)
    assert kept.columns == docs.columns and X.document_mixture(nothing, 0.7).count() == 0
