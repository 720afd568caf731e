"""The pipeline's stages take effect, on all that the stage before kept."""

import re

import corpus_pipeline

from tests.llm.test_dedup import brute_lines


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert docs.columns == columns
        seen[name] = (before, docs)
    before, after = seen["line_dedup"]
    expected = brute_lines([(r.doc_id, r.text) for r in before.collect()])
    assert {r.doc_id: r.text for r in after.collect()} == {i: x[2] for i, x in expected.items()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    before, after = seen["quality_rules"]
    kept = {r.doc_id for r in after.collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in good) / len(good) > 0.9 and after.count() < before.count()
    before, after = seen["simhash_near_dedup"]
    assert {r.doc_id for r in after.collect()} <= {r.doc_id for r in before.collect()}
    before, after = seen["source_mixing"]
    words = lambda df: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in df.collect())
    assert abs(words(after) - words(before)) < 0.02 * words(before)
    assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in after.collect()}
    assert corpus_pipeline.ORACLE_SQL is None
