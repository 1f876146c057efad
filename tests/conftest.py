import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMOKE_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from funnelworks.session import get_session

    # spark.checkpoint.dir comes from the environment when configured; otherwise
    # checkpoint_root() gives this local session a private folder.
    spark = get_session("local[4]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


@pytest.fixture
def tmp_dir():
    return tempfile.mkdtemp(prefix="funnelworks-test-")
