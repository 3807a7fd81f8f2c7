import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from ledgerlens.session import get_session
    s = get_session("local[4]", shuffle_partitions=4, app_name="ledgerlens-tests")
    yield s


@pytest.fixture(scope="session")
def duck_con():
    from ledgerlens.plans.verify import duck
    return duck(SMALL)
