import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--conf spark.ui.showConsoleProgress=false --conf spark.driver.memory=8g pyspark-shell")


@pytest.fixture(scope="session")
def spark():
    from leafscan.session import build_session

    session = build_session("leafscan-tests", "local[8]", 8)
    session.sparkContext.setLogLevel("ERROR")
    return session
