import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from ebbtide.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = local_session("4", "ebbtide-tests", str(tmp_path_factory.mktemp("scratch")))
    yield s
    s.stop()


@pytest.fixture
def ranged(monkeypatch):
    """Force the many-range path of the distributed ranks on small data."""
    from ebbtide.operators import ranks

    monkeypatch.setattr(ranks, "SAMPLE_ONE_IN", 3)
    monkeypatch.setattr(ranks, "MIN_SAMPLED", 2)
    monkeypatch.setattr(ranks, "RANGES", 7)
    monkeypatch.setattr(ranks, "PER_LOT", 4)
