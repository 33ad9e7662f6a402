import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from skewline.session import build_session

    shared = tmp_path_factory.mktemp("shared")
    os.environ.setdefault("SPARK_LOCAL_DIRS", str(tmp_path_factory.mktemp("local")))
    s = build_session(
        "tests", f"local[{os.environ.get('TEST_CPUS', 4)}]", spark__sql__shuffle__partitions="4", spark__driver__memory="4g", spark__checkpoint__dir=f"file://{shared}",
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
