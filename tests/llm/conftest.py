from __future__ import annotations

import pytest


@pytest.fixture
def documents(spark):
    """A maker of documents tables from (doc_id, text) rows, with a column that clashes with names the operators use."""

    def make(rows, lang="en", source="src"):
        data = [(i, t, lang, source, None if t is None else len(t), "extra") for i, t in rows]
        return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, n_words string")

    return make


def words(n, seed):
    import random

    r = random.Random(seed)
    return ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 8))) for _ in range(n)]


ODD = ["", None, " \n\t ", "one", "é" * 500, "a " * 3000, "x\ty\x0bz\r\n  q", "</s>[INST]", "日本 語　 ▁ \x00 end"]


@pytest.fixture
def odd(documents):
    """Null, empty, wordless, long and strange texts, a repeated row and a null id."""
    rows = [(k, t) for k, t in enumerate(ODD)] + [(5, ODD[5]), (None, "null id text here"), (40, "one")]
    return documents(rows), rows
