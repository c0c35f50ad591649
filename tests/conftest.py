import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from corpuslens.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("8")
    yield s
    s.stop()
