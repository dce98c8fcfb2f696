import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from contextmill.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("contextmill-tests", "8", "8g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
