import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from cohortlab.session import local_session

    session = local_session(4, "tests", **{"spark.driver.memory": "4g", "spark.sql.shuffle.partitions": "4"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    if not Path(SMALL).exists():
        pytest.skip("the test tables are not here")
    return SMALL


@pytest.fixture(scope="session")
def duck(small):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in Path(small).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
    return con
