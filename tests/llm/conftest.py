import pytest
from invented_prose import prose

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Rows as DataFrames with columns that clash with names the operators use inside."""

    def make(rows):
        df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA)
        from pyspark.sql import functions as F

        for name in ("chunk", "key", "n", "mark", "_id", "_row", "_drops", "bucket", "train", "node", "first"):
            df = df.withColumn(name, F.lit("clash"))
        return df

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, a very long one, ties, repeated rows and repeated ids."""
    long = prose(99, 30_000)
    return [
        (1, prose(1, 80)), (2, prose(1, 80)), (3, None), (4, ""), (5, " \n\t\n "), (6, long), (7, long + " end"), (8, "x"), (9, "Ünïcödé ñandú 漢字 " * 30),
        (10, prose(2, 40) + "\n" + prose(3, 40)), (10, prose(2, 40) + "\n" + prose(3, 40)), (11, prose(3, 40) + "\n" + prose(2, 40)), (None, prose(1, 80)), (None, None), (12, "a" * 500), (13, "a" * 300),
    ]
