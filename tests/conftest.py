import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from gleanery.session import importable, session

    s = session("tests", 4)
    s.conf.set("spark.sql.shuffle.partitions", "4")
    importable(s)
    return s
