import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.path.dirname(os.path.dirname(os.path.abspath(__file__))) + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from strandweave.session import session

    spark = session("local[4]", partitions=4, checkpoint=f"file://{tmp_path_factory.mktemp('shared')}")
    yield spark
    spark.stop()
