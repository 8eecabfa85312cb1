import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from strandline import session

    built = session.build(
        "tests",
        "local[4]",
        **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"},
    )
    built.sparkContext.setLogLevel("ERROR")
    built.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    yield built
    built.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
