import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from foliant.session import session

    at = tmp_path_factory.mktemp("spark")
    own = {"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.sql.warehouse.dir": str(at / "warehouse"), "spark.checkpoint.dir": f"file://{at}/shared"}
    return session(4, "tests", **own)


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
