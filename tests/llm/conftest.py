from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parent.parent), str(Path(__file__).resolve().parent)]


@pytest.fixture(scope="session")
def docs(spark):
    from cases import ROWS

    rows = [(*r, 0, "x", 1.5, [1]) for r in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, id int, key string, n double, node array<int>").repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.filter("false")
