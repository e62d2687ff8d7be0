import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tabulon.session import get_session
    s = get_session("local[4]", 4, app_name="tabulon-tests")
    yield s
    s.stop()


def rows(df, *cols):
    """Collect ``cols`` of ``df`` as sorted tuples."""
    return sorted(tuple(r[c] for c in cols) for r in df.collect())
