import random

import numpy as np
import pytest

from meshlark.llm import pieces as P


@pytest.fixture(scope="module")
def vocabulary():
    return P.Vocabulary.load()


@pytest.fixture(scope="module")
def own(vocabulary):
    return P.Codec(vocabulary)


def best_score(codec, unit):
    """By a table over all substrings."""
    scores = {p: s for i, (p, s) in enumerate(zip(codec.vocabulary.pieces, codec.vocabulary.scores, strict=True)) if i not in codec.vocabulary.skip}
    best = [0.0] + [float("-inf")] * len(unit)
    for end in range(1, len(unit) + 1):
        for start in range(max(0, end - 20), end):
            part = unit[start:end]
            s = scores.get(part, codec.unknown if len(part) == 1 else None)
            if s is not None:
                best[end] = max(best[end], best[start] + s)
    return best[-1]


@pytest.mark.parametrize("text", ["", " ", "  two  spaces ", "a\nb\r\n\tc", "▁", "a▁b▁▁", "日本語 \U0001f600", "x" * 3000, "café́ \u0000", "the end\n"])
def test_round_trip(own, text):
    assert own.decode(own.encode(text)) == text


def test_best_segmentation(own):
    r = random.Random(1)
    for _ in range(300):
        unit = "▁" + "".join(r.choice("thernd sioéü日q").replace(" ", "") for _ in range(r.randrange(1, 14)))
        found = own.viterbi(unit)
        score = sum(own.unknown if i < 0 else own.vocabulary.scores[i] for i in found)
        assert score == best_score(own, unit)
        assert sum(1 if i < 0 else len(own.vocabulary.pieces[i]) for i in found) == len(unit)


def test_units_do_not_change_the_best(own):
    """The whole text at once has the same score as its units apart."""
    text = "▁the▁rest▁▁of▁then▁it▁was"
    whole = own.viterbi(text)
    parts = [i for u in own.units(text) for i in own.viterbi(u)]
    assert sum(own.vocabulary.scores[i] for i in whole) == sum(own.vocabulary.scores[i] for i in parts)


def test_memory_is_bounded(vocabulary, monkeypatch):
    monkeypatch.setattr(P, "REMEMBERED", 10)
    small = P.Codec(vocabulary)
    text = " ".join(f"word{i}" for i in range(100))
    assert np.array_equal(small.encode(text), P.Codec(vocabulary).encode(text)) and len(small.memory) <= 10


def test_awkward_rows(awkward, nothing, clashing, vocabulary):
    encoded = P.encode(clashing(awkward), vocabulary)
    rows = encoded.collect()
    assert len(rows) == awkward.count() and all(r["round_trip"] for r in rows)
    back = sorted((r["doc_id"] or 0, r["text"]) for r in P.decode(encoded, vocabulary).collect())
    assert back == sorted((r["doc_id"] or 0, r["text"] or "") for r in awkward.collect())
    assert P.encode(nothing, vocabulary).count() == 0
