import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH")) if x)
os.environ.setdefault("OMP_NUM_THREADS", "2")

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from sidera.session import session

    yield session("local[8]", 8)


@pytest.fixture(scope="session")
def sf():
    return SF
