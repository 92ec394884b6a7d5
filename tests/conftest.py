import os
import sys
from pathlib import Path

import pytest

HERE = Path(__file__).resolve().parent
sys.path.insert(0, str(HERE.parent))
# Python workers import the package and the helper functions of the test modules.
os.environ["PYTHONPATH"] = os.pathsep.join([str(HERE.parent), str(HERE), os.environ.get("PYTHONPATH", "")])

from shelfmark.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("shelfmark-tests", "8", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def apply(spark):
    """Run a column function over texts and return the results in order."""
    from pyspark.sql import functions as F

    def run(fn, *texts):
        rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
        return [r.v for r in rows.select("i", fn(F.col("t")).alias("v")).orderBy("i").collect()]

    return run
