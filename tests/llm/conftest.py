import os

import pytest


@pytest.fixture(scope="session")
def sf_dir():
    found = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
    if not os.path.isdir(found):
        pytest.skip("no test tables")
    return found
