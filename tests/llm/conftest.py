"""Small document tables with every awkward case."""

from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    """n words that depend on the seed, with stop words among them."""
    out, x = [], seed * 7919 + 1
    for i in range(n):
        x = (x * 48271 + 11) % 2147483647
        out.append("the" if i % 7 == 0 else "of" if i % 11 == 0 else f"w{x % 997}x")
    return " ".join(out)


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties, odd white space."""
    rows = [
        (1, prose(1, 120), "en", "a", 5),
        (2, prose(2, 80) + "\n" + prose(3, 60), "en", "b", 5),
        (3, None, None, None, None),
        (None, prose(4, 70), "de", "a", 1),
        (4, "", "en", "a", 0),
        (5, " \t\n\x0b \r\n", "en", None, 6),
        (6, prose(1, 120), "en", "b", 5),
        (6, prose(1, 120), "en", "b", 5),
        (7, prose(5, 20000), "fr", "c", 9),
        (8, "word", "es", "a", 4),
        (9, "x" * 50000, "es", "a", 50000),
        (10, "▁ a▁b \U0001f600 日本 café \u0000 end", "zz", "d", 3),
        (11, "a b a b a b a b\n" * 40, "en", "a", 3),
        (12, "$$$ ### %%% |||\n- one\n- two ...\n- three …", "en", "a", 3),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing():
    """Adds columns with the names that operators give to their outputs."""
    names = "kept score weight probability n_lines n_dropped n_words base_failed shard ids class_id node line h1 h2 group key first topic failed media feature".split()

    def add(df):
        from pyspark.sql import functions as F

        return df.withColumns({n: F.lit(7) for n in names if n not in df.columns})

    return add
