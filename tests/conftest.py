import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from stratafile.schema import FILES, SCANS  # noqa: E402
from stratafile.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, 4)
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture
def make_files(spark):
    """Catalog rows from dicts; what isn't given is NULL."""

    def make(*rows):
        return spark.createDataFrame([tuple(r.get(f.name) for f in FILES) for r in rows], FILES)

    return make


@pytest.fixture
def make_scans(spark):
    def make(*rows):
        return spark.createDataFrame([tuple(r.get(f.name) for f in SCANS) for r in rows], SCANS)

    return make
