"""One small local session for all tests."""

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from quillstone.session import build_session

    work = tmp_path_factory.mktemp("work")
    session = build_session("local[4]", 4, **{"spark.driver.memory": "4g", "spark.checkpoint.dir": f"file://{work}", "spark.sql.warehouse.dir": f"file://{work}/warehouse"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
