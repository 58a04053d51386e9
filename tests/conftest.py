import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from rollcall.session import build_session, drop_tables

    session = build_session("tests", 8, partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    drop_tables(session)
    session.stop()


@pytest.fixture
def tight(monkeypatch):
    """Thresholds so small that every group counts as huge and every table as large."""
    from rollcall.operators import grouped

    monkeypatch.setattr(grouped, "GROUP_ROWS", 5)
    monkeypatch.setattr(grouped, "BROADCAST_ROWS", 2)
