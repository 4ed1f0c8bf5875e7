import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from postmill.session import get_session

    session = get_session(
        "local[8]",
        "tests",
        **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "6g", "spark.default.parallelism": "8"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
