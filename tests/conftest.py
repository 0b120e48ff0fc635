import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lettermill.session import builder  # noqa: E402

DATA = os.environ.get("LETTERMILL_TESTDATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    s = builder("tests", "4").config("spark.sql.shuffle.partitions", "4").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def small():
    path = f"{DATA}/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("no test data here")
    return path


@pytest.fixture(scope="session")
def medium():
    path = f"{DATA}/sf0.01"
    if not os.path.isdir(path):
        pytest.skip("no test data here")
    return path
