from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def odd(spark):
    from fixtures import documents

    return documents(spark)


@pytest.fixture(scope="session")
def empty(spark):
    from fixtures import nothing

    return nothing(spark)


@pytest.fixture(scope="session")
def sf():
    folder = Path("/root/testdata/sf0.01")
    if not folder.exists():
        pytest.skip("the data tables are not there")
    return str(folder)
