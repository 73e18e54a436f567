"""The whole pipeline over the small tables, stage by stage."""

import corpus_pipeline
from brambling.llm import base

from .test_corpus_operators import brute_classes


def test_stages(spark, sf):
    docs = base.table(spark, sf, "documents")
    seen = {}
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = base.stored(stage(spark, before, sf), f"test-{name}")
        seen[name] = (before.collect(), after.collect())
        if name != "tokens":
            assert after.columns == docs.columns
        before = after
    rows, kept = seen["near_duplicates"]
    assert sorted(r.doc_id for r in kept) == sorted(set(brute_classes([(r.doc_id, r.text) for r in rows]).values()))
    rows, kept = seen["toxicity"]
    assert {tuple(r) for r in kept} <= {tuple(r) for r in rows} and len(kept) > 0.8 * len(rows)
    rows, mixed = seen["mixing"]
    tokens = seen["tokens"][1]
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in rows} and sorted(r.doc_id for r in tokens) == sorted(r.doc_id for r in mixed)
    ends = sorted((r.start, r.n_tokens) for r in tokens)
    assert all(a + n == b for (a, n), (b, _) in zip(ends, ends[1:]))
    assert {r.doc_id: r.ids_crc32 for r in corpus_pipeline.run(spark, sf).collect()} == {r.doc_id: r.ids_crc32 for r in tokens}
