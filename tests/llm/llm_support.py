import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

PIECES = "/opt/tokenizers/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def llm(spark):
    from shoal.llm.common import ready

    ready(spark)
    return spark


@pytest.fixture
def docs(llm):
    """A table of documents from texts; extra columns have names that operators use inside."""

    def make(texts, ids=None):
        ids = list(range(len(texts))) if ids is None else ids
        rows = [(i, t, "en", "s", 7, "x") for i, t in zip(ids, texts)]
        return llm.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long, row string")

    return make


def by_id(df, *columns):
    return {r.doc_id: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}
