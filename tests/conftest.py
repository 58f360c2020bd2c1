import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from turnline.session import local_session  # noqa: E402

DATA_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session("turnline-tests", cores="8")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data_dir():
    return DATA_DIR


@pytest.fixture(scope="session")
def flights(spark, data_dir):
    from turnline.sources import derived

    return derived.flights(spark, data_dir)


@pytest.fixture(scope="session")
def links(spark, data_dir):
    from turnline.sources import derived

    return derived.links(spark, data_dir)
