import pytest

LONG = " ".join(f"word{i % 977} tail{i % 13}." for i in range(30_000))
#: Nulls in any column, empty and very long texts, ties and repeated rows.
ODD = [
    (1, "The same words stand here. Again and again they stand.\nA second line, number 17.", "en", "s1", 5),
    (2, "The same words stand here. Again and again they stand.\nA second line, number 17.", "en", "s1", 5),
    (2, "The same words stand here. Again and again they stand.\nA second line, number 17.", "en", "s1", 5),
    (3, "", "en", "s2", 0), (4, None, None, None, None), (5, "   \n\t\n ", "de", None, 3),
    (6, "one two", None, "s2", 7), (None, "a null id has words too", "en", "s1", 1),
    (7, LONG, "en", "s1", len(LONG)), (8, "İstanbul ΣΑΣ <|endoftext|>x é́ \x1c日本'S don't", "fr", "s3", 4),
    (9, "All rights reserved. Licenced under the Apache Licence, Version 2.0!", "en", "s3", 4),
    (9, "another text of a repeated id", "en", "s3", 4),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows with further columns whose names operators use themselves."""
    rows = [(*r, 1, "x", 2.0, True) for r in ODD]
    return spark.createDataFrame(rows, f"{SCHEMA}, size int, row string, target double, kept boolean")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
