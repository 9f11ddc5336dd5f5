import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))  # Python workers, whatever the working folder


@pytest.fixture(scope="session")
def spark():
    from vigilia.session import local_session
    s = local_session("*", shuffle_partitions=8, app="vigilia-tests")
    yield s
    s.stop()
