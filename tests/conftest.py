import os
import sys
from datetime import datetime

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from driftline import session  # noqa: E402

SMALL = "/root/testdata/sf0.001"
NOW = datetime(2002, 6, 1, 12, 0)


@pytest.fixture(scope="session")
def spark():
    built = session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "6g",
        },
    )
    built.sparkContext.setLogLevel("ERROR")
    yield built
    built.stop()


@pytest.fixture(scope="session")
def sf():
    return SMALL


@pytest.fixture(scope="session")
def db():
    connection = duckdb.connect()
    for file in sorted(os.listdir(SMALL)):
        connection.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SMALL}/{file}'")
    return connection


@pytest.fixture
def root(spark):
    from driftline.session import new_folder

    return new_folder(spark, "tests")
