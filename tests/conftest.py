import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from newsloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", cpus=4, spark__sql__shuffle__partitions="4", spark__default__parallelism="4")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return os.environ.get("NEWSLOOM_TESTDATA", "/root/testdata/sf0.001")
