import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tablepact.session import configured  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    base = tmp_path_factory.mktemp("spark")
    session = (configured(SparkSession.builder.master("local[8]").appName("tablepact-tests"))
               .config("spark.sql.shuffle.partitions", "8")
               .config("spark.checkpoint.dir", str(base / "checkpoints"))
               .config("spark.sql.warehouse.dir", str(base / "warehouse"))
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
