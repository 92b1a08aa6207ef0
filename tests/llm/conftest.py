import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, n long, id long, comp long, block long"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, and extra columns with the operators' own names."""
    texts = [None, "", "   \n", "Released under the MIT License.", "one two three four five six seven", "One  two\tthree FOUR five six seven", "word " * 20_000, "日本 \U0001f600 ﬁ İx é", "a" * 50_000, "x", "a<|endoftext|>b", "漢字仮名" * 20_000]
    rows = [(i, t, "en" if i % 2 else None, None, None, "k", 1, i, i, 0) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[4], rows[9], (None, "one two three four five six seven", None, None, None, None, None, None, None, None)], DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="session")
def vocab():
    return pytest.importorskip("public_tokenizers")
