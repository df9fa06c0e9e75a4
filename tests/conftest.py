import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tessera.session import get_session

    spark = get_session("local[4]", {"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("ckpt")), "spark.ui.enabled": "false", "spark.driver.memory": "3g"})
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()
