import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))

SF_DIR = os.environ.get("FLEETLENS_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from fleetlens.session import build_session

    session = build_session(master="local[8]", cpus=8)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def fleet(spark):
    from fleetlens.sources.fleet import Fleet

    return Fleet(spark, SF_DIR)


@pytest.fixture(scope="session")
def make(spark):
    """DataFrame from rows and a DDL schema."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)


def values(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.select(*cols).collect()), key=lambda t: tuple((v is None, str(v)) for v in t))


@pytest.fixture(scope="session")
def rows():
    return values
