import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from riskflow.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session("tests", cores=8, shuffle=4)


@pytest.fixture(scope="session")
def tx(spark):
    from riskflow.sources.transactions import tx_from_events

    return tx_from_events(spark, SF)


@pytest.fixture
def scratch(tmp_path):
    return str(tmp_path)
