import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parent.parent), str(Path(__file__).resolve().parent), str(Path(__file__).resolve().parent / "llm")]


@pytest.fixture(scope="session")
def spark():
    from trivalent.session import local_session

    s = local_session(8, 4, **{"spark.driver.memory": "4g", "spark.sql.adaptive.coalescePartitions.enabled": "true"})
    s.sparkContext.setLogLevel("ERROR")
    return s
