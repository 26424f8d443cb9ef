"""Small awkward tables that every operator must take."""
import pytest

LONG = " ".join(f"w{i % 997}x{i % 31}" for i in range(20_000))
BASE = "the quick brown fox jumps over the lazy dog while seven green birds sing in the old garden near a river"

# (doc_id, text, lang, source, n_chars); text null, empty, blank, one word,
# very long, repeated rows, near copies, odd characters
DOCS = [
    (1, None, "en", "a", None),
    (2, "", "en", "a", 0),
    (3, " \t\n ", None, "a", 4),
    (4, "word", "en", None, 4),
    (5, LONG, "en", "a", len(LONG)),
    (6, BASE, "en", "b", len(BASE)),
    (7, BASE, "en", "b", len(BASE)),
    (7, BASE, "en", "b", len(BASE)),
    (8, BASE + " today", "en", "b", len(BASE) + 6),
    (9, "12 34 !! ??", "en", "c", 11),
    (10, "Größe größer été 中文 😀 <|endoftext|> don't", "de", "c", 41),
    (11, "same line\nsame line\nsame line\n\n", "en", "c", 31),
    (12, "a b c d e a b c d e a b c d e", None, "c", 29),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def awkward(spark):
    """The awkward rows with further columns whose names the operators use
    for their own results."""
    df = spark.createDataFrame(DOCS, SCHEMA)
    for name in ("score", "size", "row", "_row", "node", "n", "label", "kept", "shingles", "ids"):
        df = df.selectExpr("*", f"'x' AS {name}")
    return df


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def corpus(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
