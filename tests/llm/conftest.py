"""Fixtures of the corpus tests."""

from __future__ import annotations

import pytest

from stationlake.llm.registry import let_workers_import

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def corpus(spark):
    """The session, with workers that can import the package."""
    let_workers_import(spark)
    return spark


def make_docs(spark, texts, first=0):
    """Documents with ids in order; a pair gives id and text."""
    rows = []
    for place, item in enumerate(texts):
        doc_id, text = item if isinstance(item, tuple) else (first + place, item)
        rows.append((doc_id, text, "en", "s", len(text or "")))
    return spark.createDataFrame(rows, DOCS)


def make_labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
