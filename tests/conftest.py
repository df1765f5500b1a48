from __future__ import annotations

import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def scratch():
    return tempfile.mkdtemp(prefix="mf-test-", dir="/tmp")


@pytest.fixture(scope="session")
def spark(scratch):
    from martforge.session import build_session
    s = build_session("local[*]", shuffle_partitions=8, scratch_dir=scratch)
    yield s
    s.stop()


@pytest.fixture()
def tmpdir_(scratch):
    return tempfile.mkdtemp(prefix="case-", dir=scratch)
