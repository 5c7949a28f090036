from __future__ import annotations

import pytest

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture
def make_docs(spark):
    """A documents table from texts, or from (doc_id, text[, source]) tuples, over several partitions."""

    def make(*items):
        rows = []
        for i, x in enumerate(items):
            x = x if isinstance(x, tuple) else (i, x)
            rows.append((x[0], x[1], "en", x[2] if len(x) > 2 else "s", len(x[1]) if x[1] is not None else None))
        return spark.createDataFrame(rows, DOCS).repartition(3)

    return make
