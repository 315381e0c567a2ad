import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import SparkSession  # noqa: E402

from galleyproof.session import CONF  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = SparkSession.builder.master("local[4]").config(map=CONF).config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session
