import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from wardline.session import local_session

    return local_session(4, shuffle_partitions=4, memory="4g")


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture()
def tables(spark, sf_dir):
    from suite.registry import Tables

    return Tables(spark, sf_dir)
