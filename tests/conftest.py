import pytest

from papyra.session import local_session
from papyra.ship import ship


@pytest.fixture(scope="session")
def spark():
    s = local_session("4", "papyra-tests")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    yield s
    s.stop()
