import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark, sf):
    from turnloom.llm.common import arrow_rows

    arrow_rows(spark)
    return spark.read.parquet(f"{sf}/documents.parquet").cache()


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty, blank and long texts, ties, repeated rows, clashing columns."""
    long = "word" + " lorem ipsum dolor sit amet" * 3000
    same = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    rows = [
        (1, same, "en", "a", 1),
        (2, same, None, None, None),
        (2, same, None, None, None),
        (3, same.upper(), "en", "a", 1),
        (4, None, "en", "a", 1),
        (5, "", "en", "a", 1),
        (6, " \t\n\x0b ", "en", "a", 1),
        (None, same, "en", "a", 1),
        (None, None, None, None, None),
        (7, long, "en", "a", 1),
        (8, long, "en", "b", 1),
        (9, "x" * 5000, "en", "b", 1),
        (10, "ÜBER über x İstanbul Σίσυφος <|endoftext|> é 漢字", "de", "b", 1),
        (11, "tail " + same + " end", "en", "b", 1),
        (11, "other text under one id", "en", "b", 1),
    ]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("fp", "digest", "quality", "token_ids", "decoded", "n_pii", "piece", "copy", "norm", "score", "keep"):
        df = df.withColumn(name, F.lit(None).cast("string"))
    return df.cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
