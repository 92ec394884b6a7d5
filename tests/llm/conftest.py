import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """Documents from (doc_id, text) pairs, with columns that clash with names the operators use inside."""
    from pyspark.sql import functions as F

    def make(rows):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        return df.withColumns({"h": F.lit("x"), "k": F.lit(1), "runs": F.lit(0), "row": F.lit("r"), "leaks": F.lit(None).cast("string"), "d": F.lit(2)})

    return make
