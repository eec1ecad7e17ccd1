from __future__ import annotations

import os

import pytest


@pytest.fixture(scope="session")
def medium():
    d = "/root/testdata/sf0.01"
    if not os.path.isdir(d):
        pytest.skip(f"{d} isn't there")
    return d
