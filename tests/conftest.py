import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tidewatt import get_session

    session = get_session(
        "tests",
        **{
            "spark.master": os.environ.get("SPARK_TEST_MASTER", "local[8]"),
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


DATA = os.environ.get("TIDEWATT_TESTDATA", "/root/testdata")


@pytest.fixture(scope="session")
def sf_dir():
    return f"{DATA}/sf0.001"
