import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from dialoom.session import build_session

    session = build_session("tests", cpus=4, shuffle=4)
    yield session
    session.stop()
