import os

import pytest

# Python workers find the package by this path
os.environ["PYTHONPATH"] = os.pathsep.join([os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def far(spark):
    return spark
