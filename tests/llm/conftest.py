import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from govlake.session import local_session
    return local_session(cores="*", shuffle_partitions=8, app="govlake-tests")


@pytest.fixture
def docs(spark):
    """A frame of documents from (doc_id, text) rows, with columns whose names
    clash with the operators' own."""
    def make(rows, schema="doc_id bigint, text string, block int, n_lines string, kept boolean, slot string"):
        return spark.createDataFrame([(i, t, 7, "x", None, "y") for i, t in rows], schema)
    return make
