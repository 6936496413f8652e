import hashlib

from pyspark.sql import functions as F

from marquee.llm import exact_dedup as X
from marquee.llm import queries as Q


def expected(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r.text or "", []).append(r.doc_id)
    out = []
    for r in rows:
        ids = groups[r.text or ""]
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        out.append((r.doc_id, keep, len(ids), hashlib.sha256((r.text or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_dirty_rows(spark, dirty):
    got = X.exact_duplicates(dirty).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == expected(dirty.collect())
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_survivors_keep_their_columns(spark, dirty):
    got = X.drop_exact_duplicates(dirty)
    assert got.dtypes == dirty.dtypes
    assert got.exceptAll(dirty).isEmpty()
    assert got.count() == dirty.select(F.coalesce("text", F.lit(""))).distinct().count()


def test_empty_table(spark, no_docs):
    assert X.exact_duplicates(no_docs).collect() == []
    assert X.drop_exact_duplicates(no_docs).collect() == []


def test_spilling_gives_the_same(spark):
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("x"), 500), (F.col("id") % 700).cast("string")).alias("text"))
    whole = X.exact_duplicates(docs)
    spilled = X.exact_duplicates(docs, memory_budget=4000)
    assert whole.exceptAll(spilled).isEmpty() and spilled.count() == 3000
    assert X.drop_exact_duplicates(docs, memory_budget=4000).count() == 700


def test_equal_hashes_do_not_merge_different_contents():
    table = X.ContentTable()
    for i in range(2000):
        table.add([7, b"%d" % (i % 1000), X._rank(i, i), None, 1, [i], []])
    assert len(table.rows) == 1000 and all(r[4] == 2 for r in table.rows)


def test_query_on_a_table(spark, sf0001):
    docs = spark.read.parquet(f"{sf0001}/documents.parquet").collect()
    got = Q.QUERIES["op10_grace_exact_dedup"](spark, sf0001).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == expected(docs)
