import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from netweave.session import local_session  # noqa: E402

TESTDATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", "8", memory="6g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf(spark):
    if not os.path.isdir(TESTDATA):
        pytest.skip("no test data")
    return TESTDATA
