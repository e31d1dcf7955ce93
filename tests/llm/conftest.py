import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from helpers import frame, make_texts  # noqa: E402


@pytest.fixture(scope="session")
def rows():
    texts = make_texts()
    out = [(i * 3 % 97, t) for i, t in enumerate(texts)]
    assert len({i for i, _ in out}) == len(out)
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return frame(spark, rows).persist()


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
