import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from codexmill.session import session

    s = session("4", CODEX_TEST="1")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
