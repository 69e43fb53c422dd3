"""One local session for all tests."""

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from lectern.session import clear_tables, local_session

    session = local_session(4, 4, "4g", spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")))
    yield session
    clear_tables(session)
    session.stop()
