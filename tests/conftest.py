import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
for p in (ROOT, os.path.join(ROOT, "tests")):
    if p not in sys.path:
        sys.path.insert(0, p)

SF001 = "/root/testdata/sf0.01"
SF0001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from fleetlens.session import build_session

    warehouse = tempfile.mkdtemp(prefix="fleetlens-warehouse-")
    session = build_session(
        "local[4]",
        shuffle_partitions=4,
        app_name="fleetlens-tests",
        extra={"spark.sql.warehouse.dir": warehouse},
    )
    yield session
    session.stop()
