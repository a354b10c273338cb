import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
# Python workers must import the test modules that define client functions
os.environ["PYTHONPATH"] = os.pathsep.join(
    [ROOT, os.path.join(ROOT, "tests")] + [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p])

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pricewright.session import get_session
    s = get_session(master="local[*]", extra={"spark.sql.shuffle.partitions": "8"})
    yield s
    s.stop()
