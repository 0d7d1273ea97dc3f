import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
from tests_llm_rows import ODD  # noqa: E402


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(rows, more=""):
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long" + more)

    return make


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def odd(docs_of):
    return docs_of(ODD)


@pytest.fixture(scope="session")
def none(docs_of):
    return docs_of([])
