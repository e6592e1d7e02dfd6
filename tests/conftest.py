import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from weftgraph.session import local_session

    folder = tmp_path_factory.mktemp("spark")
    conf = {"spark.sql.warehouse.dir": str(folder / "warehouse"), "spark.checkpoint.dir": str(folder / "shared")}
    session = local_session(cores=4, partitions=4, memory="4g", app="tests", conf=conf)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
