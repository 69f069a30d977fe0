import pytest
from pyspark.sql import functions as F

CLASH = ("copy", "salt", "id", "n", "h", "bucket", "text_2", "failures", "_id", "row", "doc")


@pytest.fixture()
def documents(spark):
    """A function that makes a documents table from (doc_id, text) rows, with
    further columns whose names operators use inside."""

    def make(rows, clash=True):
        df = spark.createDataFrame([(a, b, "en", f"src{(a or 0) % 3}", len(b or "")) for a, b in rows],
                                   "doc_id long, text string, lang string, source string, n_chars long")
        return df.withColumns({c: F.lit(f"own {c}") for c in CLASH}) if clash else df

    return make
