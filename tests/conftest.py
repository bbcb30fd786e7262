import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from checks.compare import local_session  # noqa: E402
from reliefsignals.session import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = configure(local_session(4))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def one_column(spark):
    """Apply a column function to Python values and give the results in order."""
    from pyspark.sql import functions as F

    def run(function, values, kind="string"):
        rows = [(i, v) for i, v in enumerate(values)]
        df = spark.createDataFrame(rows, f"i int, v {kind}").repartition(2)
        return [r[0] for r in df.orderBy("i").select(function(F.col("v"))).collect()]

    return run
