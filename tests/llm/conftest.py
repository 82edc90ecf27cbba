from __future__ import annotations

import pytest

from monthgrain.llm.work import Work


@pytest.fixture
def work(spark, request):
    held = Work(spark, f"test-{request.node.name[:20]}")
    yield held
    held.close()


@pytest.fixture
def docs(spark):
    """A frame of (doc_id, text) with columns whose names the operators use themselves."""

    def make(texts, ids=None):
        ids = range(len(texts)) if ids is None else ids
        rows = [(i, t, None, 7, "x") for i, t in zip(ids, texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words int, component_id string")

    return make
