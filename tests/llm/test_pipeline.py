"""The pipeline, each stage against brute force on its own input."""

import corpus_pipeline as pipeline

import brute
from test_documents import cut_by_brute_force


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    junk = spark.createDataFrame(
        [(-1, None, "en", "s", 0), (-2, "12 34 --", None, None, 8)], docs.schema
    )
    docs = docs.union(junk)
    items = {r["item_id"]: r["text"]
             for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
        assert tuple(docs.columns) == pipeline.COLUMNS
        found = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "language_id":
            want = {k: t for k, t in texts.items() if k >= 0}
        elif name == "near_dedup":
            sets = {k: brute.shingles(t, 5) for k, t in texts.items()}
            first = brute.components(sets)
            want = {k: t for k, t in texts.items() if first[k] == k}
        elif name == "substring_dedup":
            cut = cut_by_brute_force(texts)
            want = {k: t for k, t in cut.items() if t == texts[k] or brute.words(t)}
        else:
            want = {k: t for k, t in texts.items() if not brute.hits(t, items)[0]}
        assert found == want, name
        assert len(want) < len(texts) or name == "substring_dedup"
        texts = found
    coded = {r["doc_id"]: r for r in pipeline.sentencepiece(spark, docs, sf_dir).collect()}
    assert coded.keys() == texts.keys() and all(r["n_tokens"] for r in coded.values())


def test_empty_and_repeated_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    twice = docs.union(docs.where("doc_id < 3"))
    assert pipeline.near_dedup(spark, twice, sf_dir).where("doc_id = 1").count() <= 1
    none = docs.limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, none, sf_dir).count() == 0
