"""Small tables with the awkward rows every operator must bear."""

import pytest

AWKWARD = [
    (1, "All rights reserved. Password = 'abcdef123456' and more words here to read", "en"),
    (2, None, "en"),
    (3, "", None),
    (4, "same text of two rows, which is long enough to have several shingles in it", "en"),
    (5, "same text of two rows, which is long enough to have several shingles in it", "en"),
    (5, "same text of two rows, which is long enough to have several shingles in it", "en"),
    (None, "a row without an id, that has enough words to be compared with others", "en"),
    (None, None, None),
    (7, "long " * 30000 + "end", "en"),
    (8, "no_spaces_at_all" * 3000, "en"),
    (9, "Zeichen é ñ 中文字 😀   \x00 ' \" \n\n\n tail", "de"),
    (10, "   \n\t ", "en"),
]
# Extra columns whose names operators use for themselves.
SCHEMA = "doc_id long, text string, lang string, id string, node long, n_words int, spans string, block long, digest string, __blob string, __findings int, `a.b` string"


@pytest.fixture(scope="session")
def awkward(spark):
    rows = [(i, t, lang, "x", 1, 2, "y", 3, "z", "blob", 4, "dot") for i, t, lang in AWKWARD]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
