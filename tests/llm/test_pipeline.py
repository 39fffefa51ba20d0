"""The pipeline's stages against brute force, and the registered queries."""

from pathlib import Path

import numpy as np
import pytest

from tests.llm.test_small_ops import brute_links, words

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in pipeline.STAGES:
        from tracelake.llm.common import materialize

        before, docs = docs, materialize(stage(spark, docs, sf), name)
        seen.append((name, before, docs))
        if name != "pack":
            assert docs.columns == columns, name
    by = {name: (a, b) for name, a, b in seen}
    a, b = by["exact_dedup"]
    best = {}
    for r in a.collect():
        best[r.text] = max(best.get(r.text, -1), r.doc_id)
    assert {r.doc_id for r in b.collect()} == set(best.values())
    a, b = by["jaccard_join"]
    rows = sorted(a.collect(), key=lambda r: r.doc_id)
    stay = {rows[c].doc_id for i, (_, c) in enumerate(brute_links([r.text for r in rows], 5, 4, 5)) if c == i}
    assert {r.doc_id for r in b.collect()} == stay
    a, b = by["mix_sources"]
    total = sum(len(words(r.text)) for r in a.collect())
    assert abs(sum(len(words(r.text)) for r in b.collect()) - total) < 0.2 * total
    a, b = by["pack"]
    pieces = b.collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in a.collect()}
    fill = np.bincount([r.sequence_id for r in pieces] - np.min([r.sequence_id for r in pieces]), [r.length for r in pieces]) if len({r.sequence_id >> 36 for r in pieces}) == 1 else None
    assert fill is None or fill.max() <= 4096


def test_run_leaves_one_table(spark, sf):
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(shared.glob("*/*"))
    rows = pipeline.run(spark, sf)
    assert rows.count() > 0 and [p.name for p in set(shared.glob("*/*")) - before] == ["mix_sources"]


def test_registry():
    from tracelake.llm import registry

    names = registry.queries()
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)] and set(registry.oracle_sql()) <= set(names)
