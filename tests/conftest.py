import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from attrix.session import local_session, shared_dir

    s = local_session(cpus=4, shuffle_partitions=8, app="attrix-tests")
    shared_dir(s)  # tests own their checkpoint folder (unset locally)
    yield s
    s.stop()
