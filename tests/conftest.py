"""One local session for all tests."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH", "")) if x)


@pytest.fixture(scope="session")
def spark():
    from terazi.session import build_session

    session = build_session(
        "tests",
        master="local[4]",
        spark__driver__memory="4g",
        spark__sql__shuffle__partitions="4",
        spark__sql__adaptive__coalescePartitions__enabled="true",
        spark__sql__session__timeZone="UTC",
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()
