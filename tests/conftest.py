from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from folio.session import build_session

    session = build_session("tests", "local[4]", 4, "4g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small() -> str:
    return SMALL
