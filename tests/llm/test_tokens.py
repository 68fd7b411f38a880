import re

import pyarrow as pa
import pytest

from meshlark.llm import _common as C

TEXTS = ["Hello wOrld  a\n", "", "   ", "x", "foo bar\tfoo é\x0bé end", None, "endx", "a" * 1000 + " b", "　wide　"]


@pytest.mark.parametrize("block", [1, 8, 1 << 17])
def test_words(block):
    raw, starts = C.utf8(pa.array(TEXTS))
    got = C.scan_words(raw, starts, lower=True, block=block)
    want = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in TEXTS]
    assert (got.doc_start[1:] - got.doc_start[:-1]).tolist() == [len(w) for w in want]
    seen = {}
    for h, w in zip(got.hash.tolist(), sum(want, []), strict=True):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_portions_hold_every_row():
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(TEXTS))), pa.array(TEXTS)], ["id", "text"])
    for rows, size in ((256, 16 << 20), (2, 1 << 20), (256, 10), (1, 0)):
        parts = list(C.portions(batch, 1, rows, size))
        assert sum((p.column(0).to_pylist() for p in parts), []) == list(range(len(TEXTS)))
        assert all(p.num_rows <= rows and (p.num_rows == 1 or sum(len((t or "").encode()) for t in p.column(1).to_pylist()) <= size) for p in parts)


def test_slices_keep_their_place():
    raw, starts = C.utf8(pa.array(TEXTS).slice(3, 2))
    assert bytes(raw) == "".join(TEXTS[3:5]).encode() and starts[-1] == len(raw)
