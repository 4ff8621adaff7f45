import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("TZ", "UTC")


@pytest.fixture(scope="session")
def spark():
    from engram.session import local_session

    s = local_session(4, 4, "4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s


DATA = os.environ.get("ENGRAM_DATA", "/root/testdata")


@pytest.fixture(scope="session")
def sf(request):
    return f"{DATA}/sf0.001"
