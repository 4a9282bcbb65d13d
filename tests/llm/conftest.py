import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SF = "/root/testdata/sf0.001"


@pytest.fixture
def docs(spark):
    """Documents from texts; other columns clash with names that the operators use inside."""
    def make(texts, first=0):
        rows = [(first + k, t, "en", "s", 1, "x", 5, b"k") for k, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node string, length int, key binary")
    return make
