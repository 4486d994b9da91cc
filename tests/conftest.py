"""One local session for all tests."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from glossweave.session import build_session  # noqa: E402
from glossweave.tables import ship  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", "tests", spark_sql_shuffle_partitions="4", spark_ui_showConsoleProgress="false", spark_driver_memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    yield s
    s.stop()
