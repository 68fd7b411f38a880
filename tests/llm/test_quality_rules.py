import re

from meshlark.llm import quality_rules as Q


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    at = {i + d for i, x in enumerate(windows) if windows.count(x) > 1 for d in range(3)} if len(w) < 3000 else None
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(t.count(c) for c in Q.SYMBOLS), len(lines) - len(set(lines)), None if at is None else len(at)


def test_counts_and_verdict(awkward):
    for r in Q.judge(awkward).collect():
        n, chars, symbols, dup, repeat = brute(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"]) == (n, chars, symbols, dup)
        if repeat is not None:
            assert r["n_repeat_words"] == repeat
        assert r["base_failed"] == (n < 50 or 100 * r["n_repeat_words"] > 50 * n)
        assert not (r["base_failed"] and r["kept"])
        assert r["kept"] == (not r["base_failed"] and not r["failed"])


def test_many_repeats_take_the_other_way(spark):
    text = " ".join(f"a{i} b{i} c{i} d{i}" for i in range(60))
    r = Q.measure(spark.createDataFrame([(1, text + " " + text)], "doc_id long, text string")).first()
    assert r["n_repeat_words"] == brute(text + " " + text)[4]


def test_clean_prose_stays_and_junk_goes(spark, clashing):
    from tests.llm.conftest import prose

    rows = [(1, prose(1, 90)), (2, "$$$ ## %% && " * 60), (3, "zz qq xx vv " * 40)]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [r["doc_id"] for r in Q.filter_documents(docs).collect()] == [1]
    assert Q.filter_documents(docs).columns == docs.columns and Q.filter_documents(docs).first()["kept"] == 7


def test_no_rows(nothing):
    assert Q.judge(nothing).count() == 0


def test_one_projection_without_user_functions(awkward):
    plan = Q.judge(awkward)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)
