import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from reviewloom.session import build_session

    work = tmp_path_factory.mktemp("spark")
    s = build_session("tests", cores=4, shuffle_partitions=4, **{"spark.checkpoint.dir": str(work / "shared"), "spark.sql.warehouse.dir": str(work / "warehouse")})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    path = Path("/root/testdata/sf0.001")
    if not path.exists():
        pytest.skip("no test data here")
    return str(path)
