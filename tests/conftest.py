import os
import sys

import pytest

# the plain checks read numbers of 5,000 digits
sys.set_int_max_str_digits(0)
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from strideframe.session import local_session

    s = local_session(4, "tests", partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


def rows(df, *cols):
    """Collected tuples of the named columns, sorted."""
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)
