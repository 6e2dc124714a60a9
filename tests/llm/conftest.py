import pytest
from pyspark.sql import SparkSession

#: Nulls, empty and white-space texts, ties, repeated rows, long texts, clashing extra columns.
EDGES = [
    (0, None), (1, ""), (2, " \n\t "), (3, "one"), (None, "a row without an id " * 20), (4, "x" * 20_000), (5, "été 😀 　日本語▁ á " * 40),
    (6, "the quick brown fox jumps over the lazy dog and runs far away home again now"), (7, "the quick brown fox jumps over the lazy dog and runs far away home again today"),
    (8, "well the quick brown fox jumps over the lazy dog and runs far away home indeed"), (6, "the quick brown fox jumps over the lazy dog and runs far away home again now"),
    (9, " ".join(f"w{i % 700}" for i in range(9_000))), (10, "a b " * 40), (11, "Line one is here.\nLine one is here.\n | a | b | c | d\n"), (12, "<s> <unk> <|endoftext|> </s>\x00\x1c end  "),
]


@pytest.fixture(scope="session")
def spark():
    session = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def edge_rows():
    return EDGES


@pytest.fixture(scope="session")
def edge_docs(spark):
    rows = [(i, t, "en", None, 1, "clash", 2, 3) for i, t in EDGES]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp string, seed long, n_words long").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def corpus(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
