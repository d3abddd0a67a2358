import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from pagelake.session import local_session

    return local_session(4, memory="6g", **{"spark.sql.shuffle.partitions": "4"})


@pytest.fixture(scope="session")
def data():
    root = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
    if not root.exists():
        pytest.skip("no test tables")
    return str(root)
