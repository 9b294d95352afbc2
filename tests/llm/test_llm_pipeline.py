"""The pipeline on a small corpus with planted cases."""

import corpus_pipeline
from tidewatch.llm import decontaminate, ngram_jaccard, suffix_dedup

def test_stages_take_effect(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = f"{tmp_path}/{name}"
        stage(spark, out, small).write.parquet(path)
        after = spark.read.parquet(path)
        assert after.columns == docs.columns
        before_ids, ids = {r[0] for r in out.select("doc_id").collect()}, {r[0] for r in after.select("doc_id").collect()}
        assert ids <= before_ids
        if name == "ngram_jaccard":
            groups = ngram_jaccard.link_components(out).collect()
            assert ids == {r["component_id"] for r in groups}
        if name == "suffix_dedup":
            removed = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.removals(out).collect()}
            sizes = {r["doc_id"]: len((r["text"] or "").encode()) for r in out.collect()}
            for r in after.collect():
                assert abs(len(r["text"].encode()) - (sizes[r["doc_id"]] - removed[r["doc_id"]])) <= 6 and r["n_chars"] == len(r["text"])
        if name == "decontaminate":
            items = [r["text"] for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
            assert not any(t in r["text"] for r in after.collect() for t in items)
            assert before_ids - ids == {r["doc_id"] for r in decontaminate.contamination(out, spark.read.parquet(f"{small}/benchmark.parquet")).collect() if r["contaminated"]}
        out = after
    mixed = corpus_pipeline.STAGES[-1][1](spark, out, small)
    assert {r[0] for r in mixed.select("doc_id").distinct().collect()} <= ids and set(docs.columns) < set(mixed.columns)


def test_pipeline_of_no_documents(spark, small, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{small}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.collect() == [] and {"doc_id", "text", "copy"} <= set(out.columns)
