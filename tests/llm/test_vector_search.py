import math

import duckdb
import numpy as np
import pytest

from marquee.llm import queries as Q
from marquee.llm import vector_search as S

SCHEMA = "vec_id long, embedding array<double>, label int"
CLASHES = ["row", "vector", "cell", "far", "length", "unit", "reached", "score", "rank", "share", "query_id"]


def brute_force(rows, k=10, every=100, scale=1024):
    def floor(x):
        return int(x) * scale if abs(x) >= 2**53 else math.floor(x * scale)

    kept = [(r[0], [floor(x) for x in r[1]]) for r in rows
            if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    out = []
    for i, (q_id, q) in enumerate(kept):
        if q_id is None or q_id % every:
            continue
        hits = []
        for j, (d_id, d) in enumerate(kept):
            if j != i and len(d) == len(q):
                score = sum(a * b for a, b in zip(q, d))
                hits.append((-min(max(score, -(2**63)), 2**63 - 1), d_id is None, d_id or 0, d_id))
        for rank, h in enumerate(sorted(hits)[:k], 1):
            out.append((q_id, rank, h[3], -h[0]))
    return sorted(out, key=str)


def run(df, **options):
    return sorted((tuple(r) for r in S.top_k(df, **options).collect()), key=str)


def table(n, width, seed, spread=1.0, hot=0.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, width))
    x = centres[np.where(rng.random(n) < hot, 0, rng.integers(0, 20, n))] + spread * rng.normal(size=(n, width))
    return [(int(i), v.tolist(), 0) for i, v in zip(rng.permutation(n) - n // 3, x.round(2))]


@pytest.mark.parametrize("unit,pivots,spread,hot", [
    (16384, None, 1.0, 0.0), (50, 12, 0.02, 0.5), (7, 3, 0.3, 0.9)])
def test_against_brute_force(spark, unit, pivots, spread, hot):
    rows = table(900, 8, unit, spread, hot)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert run(df, every=13, unit=unit, pivots=pivots) == brute_force(rows, every=13)


def test_bounds_spare_most_units(spark, monkeypatch):
    """With narrow families, most queries need only few of the units, and the result is whole."""
    sent = []
    written = S.written

    def keep(df, name):
        out = written(df, name)
        if name == "sent_queries":
            sent.append(out.count())
        return out

    monkeypatch.setattr(S, "written", keep)
    rows = table(2000, 16, 3, 0.01)
    df = spark.createDataFrame(rows, SCHEMA)
    assert run(df, every=10, unit=60, pivots=40, k=3) == brute_force(rows, every=10, k=3)
    assert sent[0] < 0.5 * 200 * 2000 / 60


def test_shares_of_queries(spark, monkeypatch):
    monkeypatch.setattr(S, "QUERIES", 5)
    rows = table(400, 8, 1)
    assert run(spark.createDataFrame(rows, SCHEMA), every=2, unit=50) == brute_force(rows, every=2)


def test_dirty_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i * 50, [0.1 * i, -0.2, 1.0], 0) for i in range(9)]
    rows += [(100, [0.1, 0.2, 0.3], None), (100, [0.1, 0.2, 0.3], None), (7, [0.2, -0.2, 1.0], 0), (6, [0.2, -0.2, 1.0], 0)]
    rows += [(None, [9.0, 9.0, 9.0], 0), (None, None, None), (-300, [0.0, 0.0, 0.0], 0), (500, None, 0), (600, [nan, 0.0, 0.0], 0)]
    rows += [(700, [None, 0.0, 0.0], 0), (800, [inf, 0.0, 0.0], 0), (900, [], 0), (1, [], 0), (1000, [1.0], 0), (2, [2.0], 0), (3, [-2.0] * 67, 0)]
    df = spark.createDataFrame([(*r, *["x"] * len(CLASHES)) for r in rows], SCHEMA + "".join(f", {c} string" for c in CLASHES))
    assert run(df) == brute_force(rows)
    assert run(df.repartition(5), every=1, k=3, unit=2, pivots=2) == brute_force(rows, every=1, k=3)


@pytest.mark.parametrize("size", [1e8, 1e300])
def test_large_values(spark, size):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.uniform(-1, 1, 4) * size).tolist(), 0) for i in range(60)]
    rows += [(60, [0.0] * 4, 0)]
    assert run(spark.createDataFrame(rows, SCHEMA), every=6) == brute_force(rows, every=6)


@pytest.mark.parametrize("n", [0, 1, 5])
def test_few_rows(spark, n):
    rows = [(i * 100, [1.0, 0.5], 0) for i in range(n)]
    assert run(spark.createDataFrame(rows, SCHEMA)) == brute_force(rows)


def test_oracle_sql_and_query_on_a_table(spark, sf0001):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf0001}/embeddings.parquet')")
    want = sorted(con.execute(Q.ORACLE_SQL["op13_voronoi_top_k"]).fetchall())
    assert want and sorted(tuple(r) for r in Q.QUERIES["op13_voronoi_top_k"](spark, sf0001).collect()) == want
