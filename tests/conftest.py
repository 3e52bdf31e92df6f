import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("scratch")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    from millrace.session import tune

    return tune(session)


def pytest_collection_modifyitems(items):
    """In a file, tests on the cached tables of `world` run last: what is cached stands behind every equal plan after it."""
    files = list(dict.fromkeys(t.fspath for t in items))
    items.sort(key=lambda t: (files.index(t.fspath), "world" in t.fixturenames))
