import tempfile

import pytest

from tsengine.session import get_spark


@pytest.fixture(scope="session")
def spark():
    folder = tempfile.mkdtemp(prefix="spark-")
    session = get_spark("local[4]", "tests", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__checkpoint__dir=folder, spark__local__dir=folder, spark__sql__warehouse__dir=f"{folder}/warehouse")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
