import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

from docsieve.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "docsieve-tests", **{"spark.driver.memory": "4g"})
    yield session
    session.stop()


@pytest.fixture
def rows(spark):
    """Collect a DataFrame as plain dicts."""
    return lambda df: [r.asDict(recursive=True) for r in df.collect()]
