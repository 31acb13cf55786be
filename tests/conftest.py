import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from cellpulse.session import build_session
    # The checkpoint folder comes from the session's configuration; only when
    # none is configured does cellpulse.session.checkpoint_root make one.
    s = build_session("local[4]", "cellpulse-tests", shuffle_partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def local_path(uri: str) -> str:
    """Local file-system path of a ``file:`` URI (tests write fixture files by hand)."""
    return uri[len("file:"):] if uri.startswith("file:") else uri
