import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))

from skeinwork.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session("local[4]", shuffle_partitions=4, memory="6g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
