import random
import re

from meshlark.llm import line_dedup as L


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i:] == b[i + 1 :] or (len(a) == len(b) and a[i + 1 :] == b[i + 1 :])


def brute(rows, least=L.NEAR_CHARS):
    """rows: (id, text) with unique ids in order."""
    first = {}
    for d, text in rows:
        for no, line in enumerate((text or "").split("\n")):
            if re.search(r"[^\x20\x09-\x0D]", line):
                first.setdefault(line, (d, no))
    near = {a for a, f in first.items() if any(first[b] < f and a != b and min(len(a), len(b)) >= least and within_one(a, b) for b in first)}
    out = {}
    for d, text in rows:
        if text is None:
            out[d] = None
            continue
        out[d] = "\n".join(x for no, x in enumerate(text.split("\n")) if x not in first or (first[x] == (d, no) and x not in near))
    return out


def edited(line, r):
    i = r.randrange(len(line) + 1)
    kind = r.choice("ids")
    if kind == "i":
        return line[:i] + r.choice("abcé") + line[i:]
    i = min(i, len(line) - 1)
    return line[:i] + (r.choice("xyzü") if kind == "s" else "") + line[i + 1 :]


def test_against_all_pairs(spark):
    r = random.Random(5)
    base = ["".join(r.choice("abcde é") for _ in range(r.choice([10, 11, 12, 13, 20, 40, 41, 200]))) for _ in range(40)]
    pool = base + [edited(x, r) for x in base for _ in range(3)] + [edited(edited(x, r), r) for x in base] + ["aaaaaaaaaaaa", "aaaaaaaaaaa", "aaaaaaaaaab", "", " ", "\t\r", "a", "b", "The a.", "The b.", "ninechars", "ninechars!", "ninechars?"]
    rows = [(i, "\n".join(r.choice(pool) for _ in range(r.randrange(1, 9)))) for i in range(120)]
    got = {x["doc_id"]: x["text"] for x in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_numbered_lines_make_no_pairs(spark):
    """Lines that differ in one character: all but the first go, though none is next to every other."""
    rows = [(i, f"this is page number {i % 10} of the book") for i in range(10)]
    out = {r["doc_id"]: r["n_dropped"] for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {0: 0} | dict.fromkeys(range(1, 10), 1)


def test_awkward_rows(awkward, nothing, clashing):
    docs = clashing(awkward)
    out = L.dedup_lines(docs)
    got = out.collect()
    assert len(got) == awkward.count()
    by = {r["doc_id"]: r for r in got}
    assert by[3]["text"] is None and by[4]["text"] == "" and by[5]["text"] == " \t\n\x0b \r\n"
    assert by[6]["text"] == "" and by[6]["n_dropped"] == 1  # both rows with id 6 copy row 1
    assert by[1]["n_dropped"] == 0 and by[9]["n_dropped"] == 0
    assert by[11]["n_lines"] == 41 and by[11]["n_dropped"] == 39
    kept = L.filter_documents(docs)
    assert kept.columns == docs.columns and {r["n_lines"] for r in kept.collect()} == {7}
    assert L.dedup_lines(nothing).count() == 0


def test_native(awkward):
    import re

    assert not re.search("Python|Pandas|Arrow", L.dedup_lines(awkward)._jdf.queryExecution().executedPlan().toString())
