import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from doctables.session import get_session
    session = get_session("tests", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g")
    yield session
    session.stop()
