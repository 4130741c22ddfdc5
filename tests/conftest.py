import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from refinery.session import build_local

    s = build_local(master="local[*]", shuffle_partitions=8, app="refinery-tests")
    yield s
    s.stop()
