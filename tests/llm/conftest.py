import pytest

LONG = " ".join(f"w{i % 977}" for i in range(20000))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, no letters, clashing extra columns."""
    from pyspark.sql import functions as F
    base = "the quick brown fox jumps over the lazy dog and runs far away from the big bad wolf in the dark woods"
    rows = [(1, base, "en", "a"), (2, base, "en", "b"), (3, base + " again", "en", None), (4, "", "en", "a"),
            (5, None, None, None), (6, "   \t\n", "de", "b"), (7, LONG, "en", "a"), (8, LONG + " end", "en", "a"),
            (9, "one", "en", "c"), (10, "one two", None, "c"), (11, "12 34 !!", "fr", "c"),
            (12, "über été 中文 \U0001f600 x\x1cy", "fr", "c"), (None, "null id text here", "en", "a"),
            (1, base, "en", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return docs.withColumn("n_chars", F.length("text").cast("long")).withColumn("fp", F.lit("x")).withColumn(
        "component_id", F.lit(7)).withColumn("_row_id", F.lit("clash"))
