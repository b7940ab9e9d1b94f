import os
import sys

import pytest

# Test modules define engines that run inside Python workers.
os.environ["PYTHONPATH"] = os.pathsep.join(
    [os.path.dirname(os.path.abspath(__file__)), os.environ.get("PYTHONPATH", "")]
)
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from speechframe.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", partitions=4)
    yield session
    session.stop()


@pytest.fixture
def small():
    return "/root/testdata/sf0.001"
