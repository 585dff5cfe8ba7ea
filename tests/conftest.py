import pytest

from lexloom.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = local_session("tests", 4, **{"spark.sql.shuffle.partitions": "4", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("wh"))})
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("cp")))
    yield s
    s.stop()
