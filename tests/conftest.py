import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("PYTHONPATH", "")
os.environ["PYTHONPATH"] = os.path.dirname(os.path.dirname(os.path.abspath(__file__))) + ":" + os.environ["PYTHONPATH"]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from meshloom.session import local_session

    top = tmp_path_factory.mktemp("spark")
    s = local_session(4, **{"spark.sql.shuffle.partitions": "4", "spark.sql.warehouse.dir": str(top / "warehouse"), "spark.checkpoint.dir": str(top / "checkpoint"), "spark.driver.memory": "4g"})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
