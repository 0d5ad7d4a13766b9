import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # columns of the caller with names that operators use inside
    T.StructField("score", T.StringType()), T.StructField("size", T.StringType()), T.StructField("n", T.StringType()), T.StructField("keys", T.StringType()),
])


@pytest.fixture(scope="session")
def documents(spark):
    """Builds documents from (doc_id, text, lang, source); other columns are filled."""
    def build(rows):
        rows = [(i, t, lang, source, len(t or ""), "x", None, "y", "z") for i, t, lang, source in rows]
        return spark.createDataFrame(rows, DOCUMENTS)
    return build


@pytest.fixture(scope="session")
def odd_texts():
    """Texts of every odd kind: null, empty, blank, long, repeated, many scripts, controls."""
    return [None, "", " ", "\n\t \r\x0b\x0c", "a", "It's  I'LL they're 'sally ''s \"'s", "same words " * 3, "same words " * 3,
            "x" * 20_000, "word " * 30_000, "Größe Éa İzmir ǅ ﬁ é 中文 😀​", "\x00\x1c\x85 　end", "<|endoftext|> <|startoftext|>", "1234 ²³ ¼ Ⅷ ٣"]
