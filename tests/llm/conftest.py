import os

import pytest

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use themselves, as extra columns of a table.
CLASH = ["fp", "score", "found", "bucket", "copy", "features", "label", "lang_pred", "component_id", "keep", "bucket", "piece", "prediction", "rawPrediction", "g", "v", "list"]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, empty, blank and very long texts, ties, repeated rows and clashing extra columns."""
    long_ = " ".join(f"word{i % 977} and the other thing" for i in range(20_000))
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, "   \n\t ", "en", "a", 5), (4, long_, "en", "b", len(long_)), (5, "The cat sat on the mat.", "en", "b", 23),
        (6, "The cat sat on the mat.", "en", "c", 23), (6, "The cat sat on the mat.", "en", "c", 23), (7, "12345 67890 !!! ???", "de", "c", 19), (None, "The dog with no id at all", "en", None, 25),
        (8, "über die Straße läuft ein Hund 😀 und eine Katze", None, "d", 47), (9, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" \x1c end', "en", "d", 60), (10, "\x00 nul ퟿ <|endoftext|> ▁ x", "en", "d", 30),
    ]
    df = spark.createDataFrame(rows, DOC)
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(dict.fromkeys(CLASH))])


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    return SF


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
