import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from itcflow.session import get_spark
    s = get_spark("itcflow-tests", cpus=4, shuffle_partitions=4)
    yield s


@pytest.fixture(scope="session")
def duck():
    import duckdb

    from itcflow.sources.tables import DRIVER_TABLES

    def connect(sf_dir):
        con = duckdb.connect()
        for t in DRIVER_TABLES:
            p = f"{sf_dir}/{t}.parquet"
            if os.path.exists(p):
                con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
        return con
    return connect
