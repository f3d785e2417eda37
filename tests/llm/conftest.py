import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang) rows."""

    def make(rows):
        rows = [(*row, "en")[:3] for row in rows]
        return spark.createDataFrame([(i, t, lang, "src", len(t or "")) for i, t, lang in rows], DOCUMENTS)

    return make
