import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def spark():
    from assay.llm.common import prepare
    from assay.session import get_session
    s = get_session("local[4]", app="assay-corpus-tests", shuffle_partitions=4)
    prepare(s)
    return s


@pytest.fixture
def docs(spark):
    """Rows of (doc_id, text[, lang[, source]]) as a documents table."""
    def make(rows):
        full = [(*r, *[None] * (4 - len(r))) for r in rows]
        return spark.createDataFrame([(i, t, g, s, None if t is None else len(t)) for i, t, g, s in full], DOC_SCHEMA)
    return make
