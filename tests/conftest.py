import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF0001 = "/root/testdata/sf0.001"
SF001 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from skyrisk.session import local_session

    s = local_session("*", 8, app="skyrisk-tests")
    yield s


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="skyrisk-test-")
