import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from rillstone import session  # noqa: E402

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    spark = session.local(int(os.environ.get("TEST_CPUS", "8")), memory="6g", app="tests")
    yield spark
    spark.stop()


@pytest.fixture(scope="session")
def tiny():
    return f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def small():
    return f"{DATA}/sf0.01"
