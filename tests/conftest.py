import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from raterscope.session import get_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = get_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
            "spark.sql.session.timeZone": "UTC",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return DATA


@pytest.fixture(scope="session")
def ratings(spark):
    """Builds a ratings table from {user: [ratings]}."""

    def build(by_user):
        rows = [
            (user, f"movie {i}", i, None if value is None else float(value))
            for user, values in by_user.items()
            for i, value in enumerate(values)
        ]
        return spark.createDataFrame(rows, "user_id long, movie string, movie_id long, rating double")

    return build
