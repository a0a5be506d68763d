import pytest

#: Rows that every operator on documents must get along with: nulls, empty and odd texts, ties, repeated rows.
ODD = [
    (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a"),
    (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a"),
    (2, None, "en", "a"),
    (3, "", "de", None),
    (4, "  \n\t ", None, "b"),
    (5, "word", None, None),
    (None, "a row without an id but with some words in it", "en", "b"),
    (6, "é漢字🙂 <|endoftext|> ▁mark \x00 \x7f\r\nline\n\nline", "", ""),
    (7, "x" * 5000, "en", "c"),
    (8, "a b c d e f g h i j " * 400, "fr", "c"),
    (9, "the quick brown fox jumps over the lazy dog again and again", "en", "b"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def odd(spark):
    """With extra columns whose names operators might use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, SCHEMA)
    return df.withColumns({"fp": F.lit(1), "size": F.lit("s"), "src": F.lit("t"), "root": F.lit(2), "n": F.lit(None).cast("int"), "key": F.array(F.lit(1)), "part": F.lit(0.5)})


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 1, 0), (7, 0, 0), (None, 1, 0), (9, None, None), (99, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
