import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]


@pytest.fixture(scope="session")
def spark():
    from frostline.session import get_session
    ckpt = tempfile.mkdtemp(prefix="frostline-test-ckpt-")
    s = get_session("local[*]", app="frostline-tests",
                    conf={"spark.sql.shuffle.partitions": "8", "spark.checkpoint.dir": ckpt})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
