import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, text_ string, score double, fingerprint string, row string, ids string, hash long, id string, positions string, spans string"


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty, blank, one word, repeats, ties, very long and non-ASCII texts, clashing extra columns."""
    long = "word " * 30_000 + "é" * 3_000
    texts = [(1, None), (2, ""), (3, " \t\n\x0b "), (4, "one"), (5, "one two"), (6, "Same text as the next row here"), (7, "same text as the next row here"), (7, "same text as the next row here"), (8, long), (9, "日本語のテキスト と émotion naïve"), (10, "'s don't we'll  \n x　y"), (None, "a row without an id")]
    return [(i, t, None if i == 4 else "en", None, None, "x", 0.5, "f", "r", "i", 3, "d", "p", "s") for i, t in texts]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {row.doc_id: row.text for row in docs.collect()}
