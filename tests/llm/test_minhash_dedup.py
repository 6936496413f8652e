import re

import pytest
from pyspark.sql import functions as F

from marquee.llm import minhash_dedup as M
from marquee.llm import queries as Q
from marquee.llm import shingles as S
from marquee.llm.components import connected_components
from marquee.sources import files


def shingle_set(text, k):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return frozenset()
    if len(words) < k:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute_force(rows, k, percent):
    sets = [shingle_set(r.text, k) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    ids = {}
    for i, r in enumerate(rows):
        if sets[i]:
            ids.setdefault(find(i), []).append(r.doc_id)
    out = []
    for i, r in enumerate(rows):
        known = [x for x in ids.get(find(i), [r.doc_id]) if x is not None]
        out.append((r.doc_id, len(sets[i]), min(known) if known else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_dirty_rows(spark, dirty, k, percent):
    got = M.near_duplicates(dirty, shingle=k, percent=percent).collect()
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=str) == brute_force(dirty.collect(), k, percent)
    assert len({r.row for r in got}) == len(got)


def test_chains_beyond_the_hub_are_found(spark):
    """Documents that link only through others, in one bucket and across."""
    base = [f"w{i}" for i in range(100)]
    rows = []
    for step in range(12):
        words = [f"x{step}" if i < 3 * step else w for i, w in enumerate(base)]
        rows.append((100 - step, " ".join(words)))
    docs = spark.createDataFrame(rows + [(500 + i, f"other text number {i} stands alone here") for i in range(40)],
                                 "doc_id long, text string")
    got = M.near_duplicates(docs, shingle=3, percent=85).collect()
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=str) == brute_force(docs.collect(), 3, 85)


def test_survivors_keep_their_columns(spark, dirty):
    got = M.drop_near_duplicates(dirty)
    assert got.dtypes == dirty.dtypes and got.exceptAll(dirty).isEmpty()
    labels = M.near_duplicates(dirty, shingle=5, percent=80)
    assert got.count() == labels.filter("row = kept_row").count()
    assert got.filter(F.trim("text") == "").count() == dirty.filter(F.trim("text") == "").count()


def test_empty_table(spark, no_docs):
    assert M.near_duplicates(no_docs).collect() == []
    assert M.drop_near_duplicates(no_docs).collect() == []


def test_query_on_a_table(spark, sf0001):
    docs = spark.read.parquet(f"{sf0001}/documents.parquet").collect()
    got = Q.QUERIES["op9_minhash_near_dedup"](spark, sf0001).collect()
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=str) == brute_force(docs, 3, 85)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_large_buckets_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 4)
    rows = []
    for i in range(30):  # a family around each of three versions of one text
        version = [f"v{i % 3}_{j}" if j < 14 else f"w{j}" for j in range(100)]
        rows.append((i, " ".join([*version[:-1], f"end{i}"])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = M.near_duplicates(docs, shingle=3, percent=85, bands=60, rows=2).collect()
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=str) == brute_force(docs.collect(), 3, 85)


def test_signatures_estimate_similarity():
    import numpy as np
    import pyarrow as pa

    a = " ".join(f"w{i}" for i in range(1000))
    b = " ".join(f"w{i}" for i in range(100, 1100))
    values, offsets = S.shingle_sets(pa.array([a.encode(), b.encode()]), 1)
    s = S.minima(values, offsets, 400)
    assert abs((s[0] == s[1]).mean() - 900 / 1100) < 0.08
    assert (S.minima(np.zeros(0, np.uint64), np.array([0, 0]), 3) == 0xFFFFFFFF).all()


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 3), (9, 8), (8, 7), (7, 10), (2, 1)] + [(i, i + 1) for i in range(100, 160)]
    found = dict(connected_components(spark.createDataFrame(links, "u long, v long")).collect())
    assert found[3] == 1 and found[10] == 7 and all(found[i] == 100 for i in range(100, 161))
    assert connected_components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_what_nobody_reads_later_is_deleted(spark, sf0001):
    """Signatures, buckets and links go when the groups are known; texts and groups stay until the result is read."""
    docs = spark.read.parquet(f"{sf0001}/documents.parquet")
    before = len(files._SCRATCH)
    out = M.drop_near_duplicates(docs)
    assert sorted(p.rsplit("/", 1)[-1].rpartition("-")[0] for p in files._SCRATCH[before:]) == ["grouped", "texts"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ShuffledHashJoin [row") == 1 and "Broadcast" not in plan, plan
    labels = M.near_duplicates(docs)
    assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in labels.filter("row = kept_row").collect())
