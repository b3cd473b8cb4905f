import pytest

from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def docs_of(spark: SparkSession):
    """A documents table, with further columns of clashing names, from (doc_id, text, lang, source) tuples."""
    def make(rows, extra=True):
        df = spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
        if extra:
            for name in ("key", "size", "row", "score", "block", "rep", "h", "a", "b"):
                df = df.selectExpr("*", f"'x' as {name}")
        return df
    return make
