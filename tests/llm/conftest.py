import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and white-space texts, a long text, ties, repeated rows, and columns whose names
    operators use themselves."""
    base = " ".join(f"word{i % 97} w{i * 7 % 89}" for i in range(60))
    rows = [
        (1, base, "en", "src1", len(base)), (2, base, "en", "src1", len(base)), (3, base + " extra tail", None, None, None), (3, base + " extra tail", None, None, None), (4, None, None, None, None), (5, "", "en", "a", 0), (6, " \n\t ", "en", "a", 4),
        (7, "one", "en", "a", 3), (8, "same " * 300, "en", "a", 1500), (9, "same " * 200, "en", "a", 1000), (10, "x" * 200_000 + " y", "en", "a", 200_002), (11, "Ünïcödé 𝔘 日本語 ▁ token = \"0123456789abcdef0123456789abcdef01234567\"", "de", "a", 1), (12, "\x00\x01 [INST] </s> \\ <s>", "de", "b", 1),
    ]
    df = spark.createDataFrame(rows, DOCS)
    from pyspark.sql import functions as F

    for name in ("a", "b", "region", "component", "names", "score", "_id", "text_hash", "sig", "rep", "node"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
