import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from deckloom.session import local_session

    return local_session("deckloom-tests", "8", "6g")


@pytest.fixture(scope="session")
def sf():
    if not Path(SF).is_dir():
        pytest.skip("the test tables are not here")
    return SF


@pytest.fixture(scope="session")
def duck(sf):
    from oracle import database

    return database(sf)
