import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from colloquy.session import DEFAULT_CONF
    ckpt = tempfile.mkdtemp(prefix="colloquy-test-ckpt-")
    b = (SparkSession.builder.master("local[*]").appName("colloquy-tests")
         .config("spark.sql.shuffle.partitions", "8").config("spark.checkpoint.dir", ckpt))
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="colloquy-test-")
