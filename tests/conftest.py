import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tools"))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from wattline.session import local_session

    session = local_session("8", 4, scratch=f"file://{tmp_path_factory.mktemp('scratch')}")
    yield session
    session.stop()
