import pytest

#: doc_id, text, lang, source, n_chars: nulls, empty texts, repeated rows, a very long text
ODD_ROWS = [
    (1, None, "en", "a", 0), (2, "", None, None, 0), (2, "", None, None, 0), (None, "no id here, but words " * 20, "en", "b", None),
    (5, "x", "en", "a", 1), (6, "tab\tand  two blanks \n\n line ", "en", "a", 9), (7, "Ünïcode … naïve Σίσυφος 中文 words’s it's", "xx", "c", 9),
    (8, "long " * 30_000, "en", "a", 9), (9, "the quick brown fox jumps. " * 30, "en", "a", 9), (10, "the quick brown fox jumps. " * 30, "en", "a", 9),
]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Hard cases, with extra columns whose names clash with what operators add."""
    return spark.createDataFrame([(*r, 3, "k") for r in ODD_ROWS], DOCS + ", n_words long, copy string")


#: Names that operators use for columns of their own.
TAKEN = [
    "row", "stats", "_stats", "base_failed", "kept", "host", "_host", "bad_lines", "bad_symbols", "node", "label", "_several", "x", "lo", "hi", "digest", "bands", "bucket", "band", "head", "sketch", "rep", "gone", "copied", "n", "best", "component",
    "_base", "_candidates", "_spans", "spans", "merged", "rate", "cdf", "_source", "u", "_u", "own", "part", "n_copies", "copy", "shuffle_key", "p", "k", "sum", "h", "_t", "first", "packed", "windows", "ids", "start", "length", "sequence_id", "n_words", "n_tokens",
]


@pytest.fixture(scope="session")
def clashing_docs(spark):
    """Documents with an extra column of each such name, which holds that name."""
    from pyspark.sql import functions as F

    rows = [(i, f"document {i} has " + " ".join(f"w{i * k % 97}x{k}" for k in range(80)) + " token=abcdefgh1234", "en", "a", 9) for i in range(40)]
    return spark.createDataFrame(rows, DOCS).select("*", *(F.lit(f"own {c}").alias(c) for c in TAKEN))


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
