"""The pipeline stage by stage, against the operators' own decisions and a brute-force version."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from tidewatch.llm import quality

from .test_operators import brute_components

DATA = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").cache()
    now, columns = docs, docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, now, DATA).cache()
        seen[name] = (now, after)
        now = after
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == columns
    before, after = seen["quality_rules"]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in quality.rules(before).where("kept").collect()}
    before, after = seen["near_duplicates"]
    expected, _ = brute_components({r.doc_id: r.text for r in before.collect()})
    assert sorted(r.doc_id for r in after.collect()) == sorted(set(expected.values()))
    before, after = seen["source_mix"]
    assert {r.doc_id for r in after.collect()} <= {r.doc_id for r in before.collect()}
    mixed, tokens = seen["token_ids"]
    assert Counter(r.doc_id for r in tokens.collect()) == Counter(r.doc_id for r in mixed.collect())
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    kept = {r.doc_id for r in seen["quality_classifier"][1].collect()}
    good = [i for i, q in labels.items() if q == 1 and i in {r.doc_id for r in seen["quality_rules"][1].collect()}]
    assert sum(i in kept for i in good) >= 0.97 * len(good)


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").columns[:3] == ["doc_id", "source", "n_tokens"]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "near_duplicates", "source_mix", "token_ids"]
