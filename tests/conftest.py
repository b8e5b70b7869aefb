import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tempolog.plans.timeline import MAX_ROWS_SETTING  # noqa: E402
from tempolog.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", master="local[8]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
           "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(params=["whole", "cut"])
def windows(request, spark):
    """Run a test with ordinary windows, and again with every key of more than three rows cut into slices."""
    if request.param == "cut":
        spark.conf.set(MAX_ROWS_SETTING, "3")
    yield request.param
    spark.conf.unset(MAX_ROWS_SETTING)


@pytest.fixture
def tiny_windows(spark):
    spark.conf.set(MAX_ROWS_SETTING, "3")
    yield
    spark.conf.unset(MAX_ROWS_SETTING)
