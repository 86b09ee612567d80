import pytest


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture()
def docs(spark):
    """Rows with ties, repeats, nulls, odd texts and clashing column names."""
    def make(rows):
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        # Names that operators use inside must not collide with what a table brings.
        for c in ("size", "shard", "fp", "id", "rank", "slice", "node", "score", "component", "spans"):
            from pyspark.sql import functions as F

            df = df.withColumn(c, F.lit("clash"))
        return df

    return make


ODD = [
    (1, "alpha beta gamma delta", "en", "a", 22), (1, "alpha beta gamma delta", "en", "a", 22), (2, "alpha beta gamma delta", "en", None, 22), (3, None, None, "b", None), (4, "", "fr", "b", 0),
    (None, "one two", None, None, 7), (5, " \t\n ", "fr", "b", 4), (6, "é 😀 ü " * 4000, "de", "c", 24000), (7, "x", "de", "c", 1),
]


@pytest.fixture()
def odd(docs):
    return docs(ODD)


@pytest.fixture()
def none(docs):
    return docs([])
