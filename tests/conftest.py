import datetime as dt
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from ridelake.plans.session import local_session  # noqa: E402
from ridelake.sources.adapter import ride_tables  # noqa: E402
from ridelake.sources.tables import seed_tables  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NOW = dt.datetime(2026, 3, 10, 12, 0)


@pytest.fixture(scope="session")
def spark():
    session = local_session("ridelake-tests", "8", **{"spark.sql.shuffle.partitions": "4"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    return ride_tables(spark, SF_DIR)


@pytest.fixture(scope="session")
def seed(spark):
    return seed_tables(spark, NOW)


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)


def rows(df, *columns):
    """Rows as sorted tuples, for comparing without regard to order."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)
