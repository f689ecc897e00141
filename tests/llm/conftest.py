from __future__ import annotations

import pytest

from tripweave.sources.shared import written

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(25_000)) + "\nend of it"


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text, lang, source, n_chars) with nulls everywhere, empty and long texts, ties and repeated rows."""
    plain = "the quick brown fox jumps over the lazy dog and runs far away from here to there until it is very tired of it all"
    return [
        (1, plain, "en", "a", 9),
        (1, plain, "en", "a", 9),
        (1, plain + " again", "en", "a", 9),
        (2, plain, None, None, None),
        (3, None, "en", "a", 0),
        (4, "", "de", "b", 0),
        (None, None, None, None, None),
        (None, plain, "en", "b", 9),
        (5, " \n\t ", "de", "b", 4),
        (6, LONG, "en", "c", len(LONG)),
        (7, LONG + ".", "en", None, len(LONG)),
        (8, "é ß 日本語 🎉 \u0000 token = \"0123456789abcdef0123456789abcdef01234567\"", "fr", "c", 50),
        (9, "word", "es", "a", 4),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    df = spark.createDataFrame(odd_rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("id", "fp", "kept", "row", "key", "rows", "copies", "size", "name", "words", "host", "component", "text_key", "score", "label", "_row", "length", "start"):
        df = df.selectExpr("*", f"'x' as `{name}`")
    return written(df, "odd")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
