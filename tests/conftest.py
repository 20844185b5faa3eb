import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from chronofeat.session import local_session
    s = local_session(cores="*", shuffle_partitions=8)
    yield s
    s.stop()


def same_rows(a, b):
    """Multiset equality of two DataFrames (both directions of exceptAll)."""
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
