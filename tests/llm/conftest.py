from __future__ import annotations

import pytest

#: Extra columns whose names operators use themselves.
CLASH = {"key": "k", "size": -1, "range": 7, "target": 0.5, "root": 1, "token": "t", "score": 9.0, "doc": "d", "label": "x"}

LONG = " ".join(f"wort{i % 997}x{i % 13}" for i in range(30_000))
BASE = " ".join(f"alpha{i}" for i in range(120))

#: Nulls in any column, empty and very long texts, ties, repeated rows.
ROWS = [
    (0, BASE, "en", "a"),
    (1, BASE, "en", "a"),
    (2, BASE.replace("alpha7 ", "beta "), "en", "b"),
    (3, BASE.upper(), None, None),
    (4, "", "en", "b"),
    (5, None, "de", "c"),
    (6, "one", None, "c"),
    (7, "One", "en", "d"),
    (8, " \t\n ", "en", "d"),
    (9, LONG, "en", "a"),
    (9, LONG, "en", "a"),
    (None, "ohne Nummer, aber mit Text", "de", "a"),
    (None, None, None, None),
    (12, "Released under the MIT License.\nLicensed under CC BY-NC 4.0. Under the mit\tlicense", "en", "e"),
    (13, "héllo wörld \U0001f600 ça va  <|endoftext|>", "fr", "e"),
    (14, "one two", "en", "f"),
]

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    from pyspark.sql import functions as F

    rows = [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in ROWS]
    return spark.createDataFrame(rows, SCHEMA).withColumns({k: F.lit(v) for k, v in CLASH.items()})


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.where("false")


@pytest.fixture
def texts():
    return [(i, t or "") for i, t, _, _ in ROWS]
