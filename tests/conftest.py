import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from seriesloom.session import BLOCK_ROWS, build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def blocks(spark):
    """Force the blocked layout: ``blocks(7)`` makes every series of more than 7 rows a long one."""

    def choose(rows: int):
        spark.conf.set(BLOCK_ROWS, str(rows))

    yield choose
    spark.conf.unset(BLOCK_ROWS)
