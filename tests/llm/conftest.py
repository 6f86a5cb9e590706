from __future__ import annotations

import pytest

DOCUMENT = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def docs(spark):
    """Documents from (id, text) or (id, text, source); extra columns have names used inside."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), 1, "x") for r in rows]
        return spark.createDataFrame(full, DOCUMENT + ", node int, copy string")

    return make
