import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from sourceline.session import local_session, prepare
    session = prepare(local_session(4, 4, "4g"))
    yield session
    session.stop()
