"""The pipeline's stages, each against what its operator says about the stage's own input."""

import corpus_pipeline
from curbside.sources.staging import stage

SF = "/root/testdata/sf0.001"


def test_stages_follow_their_operators(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for at, (name, function) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        docs = stage(function(spark, docs, SF), name)
        if at < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
            after = {r.doc_id: r for r in docs.collect()}
            assert set(after) <= set(before)
            if name == "exact_dedup":
                groups = {}
                for r in before.values():
                    key = "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or "")
                    groups[key] = max(groups.get(key, -1), r.doc_id)
                assert set(after) == set(groups.values())
            if name == "pii":
                assert set(after) == set(before)
    whole = docs.collect()
    assert {r.doc_id for r in whole} == set(after)
    assert sum(r.length for r in whole) == sum({r.doc_id: r.doc_tokens for r in whole}.values())
