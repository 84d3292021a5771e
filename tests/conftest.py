import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from wayframe.session import build_session

    session = build_session("tests", "local[8]", 8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate columns on a single row."""

    def run(**columns):
        row = spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()
        return row.asDict()

    return run
