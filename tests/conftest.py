import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TESTDATA = "/root/testdata"


def sf_dir(sf: str) -> str:
    return os.path.join(TESTDATA, f"sf{sf}")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    builder = (
        SparkSession.builder.master("local[4]")
        .appName("marquee-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
    )
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    # Tests only: name a shared folder when the session has none.
    if not (session.conf.get("spark.checkpoint.dir", None) or session.sparkContext.getCheckpointDir()):
        d = tempfile.mkdtemp(prefix="marquee-test-ckpt-")
        session.conf.set("spark.checkpoint.dir", d)
        session.sparkContext.setCheckpointDir(d)
    yield session


@pytest.fixture(scope="session")
def sf001():
    return sf_dir("0.01")


@pytest.fixture(scope="session")
def sf0001():
    return sf_dir("0.001")
