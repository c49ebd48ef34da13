import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from sievewright.session import local_session

    s = local_session(4, **{"spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('checkpoints')}", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))})
    yield s
    s.stop()
