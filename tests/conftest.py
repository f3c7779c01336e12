import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    import tempfile

    from relspark.session import build_session

    warehouse = tempfile.mkdtemp(prefix="relspark-warehouse-")
    s = build_session(
        "local[4]", 8, app_name="relspark-tests", extra={"spark.sql.warehouse.dir": warehouse}
    )
    yield s
    s.stop()


@pytest.fixture()
def tmp_dir(tmp_path):
    return str(tmp_path)
