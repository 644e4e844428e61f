import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from parley.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return build_session("tests", cpus=4, shuffle_partitions=4)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
