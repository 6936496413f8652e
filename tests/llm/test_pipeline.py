import corpus_pipeline
from marquee.sources.files import scratch_path

from .test_packing import check


def test_stages_in_turn(spark, sf0001):
    docs = spark.read.parquet(f"{sf0001}/documents.parquet")
    first = docs.dtypes
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf0001)
        if name != "packing":
            assert out.dtypes == first
        path = scratch_path(spark, name)
        out.write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        n, m = before.count(), docs.count()
        if name == "language_id":
            assert m >= 0.98 * n and docs.exceptAll(before).isEmpty()
        if name == "exact_dedup":
            assert m == before.select("text").distinct().count()
        if name == "near_dedup":
            assert m <= n and docs.exceptAll(before).isEmpty()
            kept = docs
    texts = [(r.doc_id, r.text) for r in before.collect()]
    check(docs.collect(), texts)
    assert kept.count() > 0


def test_run_gives_packed_rows(spark, sf0001):
    rows = corpus_pipeline.run(spark, sf0001)
    assert rows.columns[:5] == ["doc_id", "piece", "start", "length", "ids_crc32"] and rows.count() > 0


def test_dirty_and_empty_tables(spark, dirty, no_docs):
    plain = no_docs.columns
    for docs in (dirty.select(*plain), no_docs):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, "")
            docs.write.format("noop").mode("overwrite").save()
