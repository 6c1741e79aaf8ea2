import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark():
    from loomgraph.session import build_session

    return build_session(cpus=4, shuffle_partitions=4, **{"spark.driver.memory": "4g", "spark.sql.autoBroadcastJoinThreshold": "1m"})


@pytest.fixture(scope="session")
def tiny():
    folder = DATA / "sf0.001"
    if not folder.exists():
        pytest.skip("no test tables")
    return str(folder)
