import pytest

#: Ids (one null, one twice), texts (null, empty, ties, a very long one), and columns of names that operators use inside.
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog again and again", "x"), (2, None, "x"), (3, "", None), (4, "   \n\t ", "y"), (5, "Été à la plage, naïve façade 日本語 🙂 ½", "y"),
    (6, "same words here and there, the same words", "x"), (7, "same words here and there, the same words", "x"), (7, "same words here and there, the same words", "x"), (None, "a row without an id", "x"), (8, "long words " * 9000, "x"), (9, "one", None),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    clashes = ["utf8", "hash", "hash_of_text", "text_hash", "kept_id", "kept_hash", "root", "block", "class", "__utf8__", "_y", "_text"]
    rows = [(i, t, s, "en", 0, 1.0, "clash", 5, *["clash"] * len(clashes)) for i, t, s in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, score double, fp string, length int, " + ", ".join(f"{c} string" for c in clashes))


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
