import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, d1 string, key string, label string, queue string, batch long, bucket string"


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, blank, very long, equal and repeated rows, and columns with clashing names."""
    base = "the quick brown fox jumps over the lazy dog and then it runs home again to sleep all day. "
    texts = [
        None, "", "  \t\n", "a", "A", "same text here", "same  text here", "same text here", base * 40, base * 40 + "x", base * 3000, base.upper() * 40,
        "été ñandú über straße " * 60, "你好 世界 " * 80, "İstanbul ﬁne \x1c\x85  <|endoftext|> don't we're 12½ €", "aaaa" * 400, "\x00\x01 nul",
        "Licensed under the MIT License. SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0\nmore", "mit license mit license apache license",
    ]
    rows = [(i, t, [None, "en", "de"][i % 3], [None, "s0", "s1", "s2"][i % 4], None, 1, "x", "k", "l", "q", 2, "b") for i, t in enumerate(texts)]
    rows += [(None, "a text without an id", "en", "s0", 3, *[None] * 7), (None, None, None, None, None, *[None] * 7), rows[8], rows[8]]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
