import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from recloom.session import local_session  # noqa: E402

SF_DIR = os.environ.get("RECLOOM_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, 8, "tests")
    yield session
    session.stop()
