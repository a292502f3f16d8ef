import os

import pytest

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    return DATA


@pytest.fixture(scope="session")
def rows_of():
    return lambda df, key: {r[key]: r for r in df.collect()}
