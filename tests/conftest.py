import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from logweave.session import local_session, ship  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(4, memory="4g", spark__sql__shuffle__partitions="4", spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")))
    yield ship(session)
    session.stop()


@pytest.fixture
def rows(spark):
    """A small table from tuples and a DDL schema."""
    return lambda data, schema: spark.createDataFrame(data, schema)
