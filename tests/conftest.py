import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from caseledger.session import local_session

    return local_session("4", 4)


@pytest.fixture(scope="session")
def tables(spark):
    from catalogue.shapes import Tables

    return Tables(spark, SF)
