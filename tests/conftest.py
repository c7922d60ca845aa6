import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from parley.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    # partitions are kept apart, so that what is carried from part to part is put to the test
    conf = {"spark.sql.shuffle.partitions": "6", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    session = local_session("8", "parley-tests", **conf)
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Evaluate a column function on a single value."""
    from pyspark.sql import functions as F

    def run(function, value, kind="string"):
        df = spark.createDataFrame([(value,)], f"v {kind}")
        return df.select(function(F.col("v")).alias("r")).first()["r"]

    return run
