import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from phylochron.session import session

    place = tmp_path_factory.mktemp("spark")
    made = session("tests", **{"spark.master": "local[4]", "spark.sql.shuffle.partitions": "2", "spark.default.parallelism": "2", "spark.ui.enabled": "false", "spark.sql.warehouse.dir": str(place / "warehouse"), "spark.driver.memory": "3g"})
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()
