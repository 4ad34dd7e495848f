import os
import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))


@pytest.fixture(scope="session")
def spark():
    from quarrystone.session import session

    shared = tempfile.mkdtemp(prefix="quarrystone-tests-")
    os.environ["PYTHONPATH"] = str(Path(__file__).parents[1])
    s = session("local[4]", 4, spark__checkpoint__dir=f"file://{shared}", spark__driver__memory="4g", spark__sql__warehouse__dir=f"{shared}/warehouse")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
