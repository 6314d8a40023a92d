import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from hourloom.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "6g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


TRIPS_EDGE = [
    ("1", "2024-03-10 01:10:00", "A", "Alpha", 1.0, 5.0),
    ("2", "2024-03-10 01:50:00", "A", "Alpha", 2.0, 5.0),
    ("3", "2024-03-10 02:30:00", "A", "Alpha", 2.0, 6.0),
    ("4", "2024-03-10 03:00:00", "A", "Alpha", 3.0, 6.0),
    ("5", "2024-03-10 05:00:00", "A", "Alpha (moved)", 9.0, 9.0),
    ("6", "2024-11-03 01:30:00", "B", "Beta", 4.0, 4.0),
    ("7", "2024-11-03 00:59:59", "B", "Beta", 4.0, 4.0),
    ("8", "2024-05-01 10:00:00", None, "Null", 1.0, 1.0),
    ("9", "not a time", "A", "Alpha", 1.0, 1.0),
    ("10", "2024-12-31 23:59:59", "B", "Beta", 4.0, 4.0),
    ("11", "2024-12-31 23:59:59.500", "B", "Beta", 4.0, 4.0),
    ("12", "2022-12-31 23:59:59", "B", "Beta", 4.0, 4.0),
    ("13", "2024-03-10 01:00:00", "C", "Gamma", None, None),
]
EDGE_LO, EDGE_HI = "2023-01-01 00:00:00", "2024-12-31 23:59:59"
TZ = "America/New_York"


@pytest.fixture
def edge(spark):
    ddl = (
        "ride_id string, started_at string, start_station_id string, start_station_name string, "
        "start_lat double, start_lng double"
    )
    return spark.createDataFrame(TRIPS_EDGE, ddl)


@pytest.fixture
def edge_clean(edge):
    from hourloom.plans import demand

    return demand.clean(edge, EDGE_LO, EDGE_HI, TZ)
