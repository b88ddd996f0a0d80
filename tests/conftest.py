import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cadenza.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, memory="6g")
    s.sparkContext.setLogLevel("OFF")
    s.conf.set("spark.sql.shuffle.partitions", "8")
    yield s


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
