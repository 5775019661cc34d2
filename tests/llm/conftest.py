import pytest

#: Columns that an input may have beside those that the operators read, named like what they make inside.
CLASHES = ["size", "copies", "n_lines", "n_dropped", "shard", "slot", "score", "key", "text_id", "part", "bucket", "band", "component_id", "kept", "id", "a", "b", "n", "place", "guest"]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, extra columns with clashing names."""
    rows = [
        (None, None, None, None),
        (None, "a b c d e f", "en", "s1"),
        (1, None, "en", None),
        (2, "", None, "s0"),
        (3, " \n\t ", "en", "s0"),
        (4, "word " * 30_000, "en", "s1"),
        (5, "ab" * 60_000, "en", "s1"),
        (6, "Same line here for all\nsame   words 1 2 3", "en", "s2"),
        (6, "Same line here for all\nsame   words 1 2 3", "en", "s2"),
        (7, "same line HERE for all\nother words \U0001f600 é 漢字 x", "fr", "s2"),
        (8, "same line HERE for all\nother words \U0001f600 é 漢字 x", "fr", "s2"),
        (9, "token = \"abc123def456\" \x01\x02\x03 ▁ <0x41>", "en", "s3"),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for name in CLASHES:
        frame = frame.selectExpr("*", f"'clash' AS {name}")
    return frame.cache()


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
