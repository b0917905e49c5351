import os

import pytest

from loamlog.session import build_session

DATA = os.environ.get("LOAMLOG_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[8]", 8, **{"spark.driver.memory": "8g", "spark.ui.enabled": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return DATA
