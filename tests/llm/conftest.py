import duckdb
import pytest

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def documents():
    """(doc_id, text, lang, source) of the whole small table."""
    return duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{SF}/documents.parquet'").fetchall()


#: Awkward rows: nulls, empty and white-space texts, ties, repeated rows, odd characters.
AWKWARD = [
    (None, None, None, None), (1, "", "en", "a"), (2, " \n\t ", "en", "a"), (3, "x", "en", None), (3, "x", "en", None), (4, "one two three four", None, "b"),
    (5, "One two  three four\n", "en", "b"), (6, "🙂 ｆｕｌｌ  ▁mark <|endoftext|> <s> naïve 梦", "zz", "c"), (None, "no id but words enough to make shingles of five", "en", "c"), (7, "12345 !!! ---", "en", "c"),
]


@pytest.fixture(scope="session")
def awkward(spark):
    """The rows above with extra columns whose names operators use inside."""
    rows = [(*r, 1, "t", 2, 3.0, [1]) for r in AWKWARD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, salt int, node string, rank int, score double, ids array<int>")


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.limit(0)
