"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names, for all operators and stages."""

from __future__ import annotations

import pytest

import corpus_pipeline
from lexweave.llm import registry
from lexweave.session import table


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_a_row_for_each_row(spark, odd, name):
    n = table(spark, odd, "pages" if name == "op9_htmltext" else "documents").count()
    rows = registry.QUERIES[name](spark, odd).collect()
    assert len(rows) >= n if name == "op10_packing" else len(rows) == n


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_empty_tables(spark, empty, name):
    assert registry.QUERIES[name](spark, empty).collect() == []


def test_stages_keep_columns(spark, odd, empty):
    for folder in (odd, empty):
        docs = table(spark, folder, "documents")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, folder)
            assert out.schema.names == docs.schema.names, name
            assert [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
            rows = out.collect()
            assert all(r["_item"] == r["_gone"] == r["bucket"] == "clash" for r in rows)
            assert bool(rows) == (folder == odd)
        assert (corpus_pipeline.run(spark, folder).count() > 0) == (folder == odd)
