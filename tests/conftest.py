import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parent.parent)]

from loomgraph.session import local_session, ship  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4)
    ship(session)
    return session


@pytest.fixture(scope="session")
def con():
    from helpers import duck

    return duck(SF_DIR)
