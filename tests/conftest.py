import os
from pathlib import Path

import pytest

from candrank.plans.session import local_session


# Python workers import the package and the tests' own callables.
_here = Path(__file__).parent
os.environ["PYTHONPATH"] = os.pathsep.join(
    [str(_here.parent), str(_here), os.environ.get("PYTHONPATH", "")]
)


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "candrank-tests", memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(autouse=True)
def _shared_folder(spark, tmp_path_factory):
    """Tests that cut a lineage write below pytest's own folder."""
    from candrank.plans import scratch

    folder = str(tmp_path_factory.getbasetemp() / "shared")
    before = spark.conf.get("spark.checkpoint.dir", None)
    if before is None:
        scratch._own_folder = lambda: folder
    yield
