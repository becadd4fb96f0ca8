from __future__ import annotations

import pytest

from lorekeep.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("4", 4, "4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
