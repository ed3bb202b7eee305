import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from segprofile.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


SCHEMA = "id long, grp string, c1 string, c2 string, x double, y double, m double"


@pytest.fixture(scope="session")
def make(spark):
    """Rows of the common edge schema; short rows are padded with nulls."""

    def build(rows):
        return spark.createDataFrame([tuple(r) + (None,) * (7 - len(r)) for r in rows], SCHEMA)

    return build
