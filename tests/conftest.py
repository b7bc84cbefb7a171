import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from rankflow.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = local_session("8", shuffle_partitions=4, app="rankflow-tests", shared=str(tmp_path_factory.mktemp("shared")))
    yield s
    s.stop()
