import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from progcorpus.session import get_spark

    s = get_spark(cores="*", shuffle_partitions=8, app="progcorpus-tests", **{"spark.driver.memory": "16g"})
    yield s


@pytest.fixture(scope="session")
def rows(spark):
    """Build a DataFrame from Python rows."""
    def make(data, schema):
        return spark.createDataFrame(data, schema)
    return make
