import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from mentionlake.session import get_session

    session = get_session("tests", "local[4]", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def value(spark):
    """Evaluate one Column over a one-row frame of literals."""
    from pyspark.sql import functions as F

    def run(build, *args):
        return spark.range(1).select(build(*[F.lit(a) for a in args]).alias("v")).first().v

    return run


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
