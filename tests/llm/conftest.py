import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def make(spark):
    """DataFrame of documents: (doc_id, text, source) rows, with more columns if asked for."""
    def build(rows, schema="doc_id long, text string, source string"):
        return spark.createDataFrame(rows, schema)

    return build
