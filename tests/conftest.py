import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ecotally.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    ckpt = tempfile.mkdtemp(prefix="ecotally-test-ckpt-")
    s = build_session(
        "ecotally-tests",
        master="local[8]",
        shuffle_partitions=8,
        extra={"spark.checkpoint.dir": ckpt, "spark.ui.showConsoleProgress": "false"},
    )
    yield s
    s.stop()


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="ecotally-test-")
