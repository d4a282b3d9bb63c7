from __future__ import annotations

import os

import pytest

from almanac.session import get_spark

SF = os.environ.get("ALMANAC_TEST_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    s = get_spark("almanac-tests", "4", 4, spark__driver__memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(SF):
        pytest.skip(f"no test tables at {SF}")
    return SF
