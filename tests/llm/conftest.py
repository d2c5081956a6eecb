import pyspark.sql.types as T
import pytest

DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture
def make_docs(spark):
    """documents from (doc_id, text) pairs, with further columns by rule."""

    def make(pairs, parts=3):
        rows = [(d, t, ["en", "de", None][i % 3], ["src0", "src1", "src5", None][i % 4], None if t is None else len(t)) for i, (d, t) in enumerate(pairs)]
        return spark.createDataFrame(rows, DOC).repartition(parts)

    return make


# Nulls, empty texts, white space only, ties, repeated rows, marks, other scripts.
EDGE = [
    (1, "one two three four five six"), (1, "one two three four five six"), (2, "One TWO three\tfour\nfive six"), (3, None), (4, ""), (5, " \t\n "), (None, "a text without an id here"), (None, None),
    (6, "x"), (7, "Été ñandú İstanbul — don't! 123"), (8, "<|endoftext|> 日本語 a b"), (9, "ends with dots... and, marks!"),
]


@pytest.fixture
def edge():
    return list(EDGE)
