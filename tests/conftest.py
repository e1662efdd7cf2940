from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from vettra.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("vettra-tests", os.environ.get("TEST_CPUS", "*"), shuffle_partitions=4)
    yield session
    session.stop()
