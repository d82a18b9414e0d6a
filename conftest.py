import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
os.environ.setdefault("PYTHONPATH", os.path.dirname(__file__))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from hazlens import session

    made = session.build(
        "local[8]",
        "tests",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoint")),
        },
    )
    made.sparkContext.setLogLevel("ERROR")
    yield made
