"""The pipeline against its stages' brute-force versions."""

import os
from collections import Counter

import pytest

import corpus_pipeline
from cairnframe.llm import langid, pii

from . import odd
from .test_pairs import brute_components, brute_leaks

pytestmark = pytest.mark.skipif(not os.path.exists(corpus_pipeline.PIECES), reason="no vocabulary file")


def test_run(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == [*docs.columns, "n_pieces", "ids", "decoded"]
    filters = langid.learn(spark, docs.where(~langid.held_out()))
    reader = langid.Reader(filters)
    rows = [(d, t) for d, t in odd.rows_of(docs) if (r := reader.decide([t])[0])[0] != "und" and r[1] >= 0.2]
    stay = {d for d, _, c in brute_components(rows) if d == c}
    rows = [(d, t) for d, t in rows if d in stay]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaked = {d for d, _ in brute_leaks(rows, items)}
    want = Counter((d, pii.redact_text(t)) for d, t in rows if d not in leaked)
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == want
    assert all(r["decoded"] == r["text"] and r["n_chars"] == len(r["text"]) for r in out.collect())
    assert 0 < len(want) < docs.count()


def test_stages_stand_odd_tables(spark, sf):
    for docs in (odd.documents(spark), odd.empty(spark)):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf)
            assert docs.columns == columns, name
        last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
        assert last.count() == docs.count()
