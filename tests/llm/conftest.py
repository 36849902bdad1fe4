import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from supplygraph.llm import common  # noqa: E402


@pytest.fixture(autouse=True)
def shipped(spark):
    common.ship(spark)


@pytest.fixture
def documents(spark):
    """A documents table with further columns whose names clash with the operators' own."""

    def make(rows):
        # rows of (doc_id, text)
        full = [(i, t, "en", f"s{k}", len(t or ""), k, "x") for k, (i, t) in enumerate(rows)]
        ddl = "doc_id long, text string, lang string, source string, n_chars long, n_words int, row string"
        return spark.createDataFrame(full, ddl)

    return make
