import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]

from paths import SF_SMALL  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from assay.session import get_session
    s = get_session("local[4]", app="assay-tests", shuffle_partitions=8)
    yield s


@pytest.fixture(scope="session")
def duck():
    from assay.plans.compare import duckdb_connection
    return duckdb_connection(SF_SMALL)
