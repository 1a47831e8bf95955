import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = sys.path[0] + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from tessera.session import get_session

    s = get_session("tests", 8, **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "6g"})
    yield s
    s.stop()
