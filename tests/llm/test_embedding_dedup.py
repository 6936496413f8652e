import numpy as np
import pytest

from marquee.llm import embedding_dedup as E
from marquee.llm import queries as Q

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute_force(rows, threshold=0.93):
    """vec_id -> (n_links, component_id) with every pair compared."""
    def usable(r):
        v = r[1]
        return r[2] is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    links = {i: set() for i in range(len(rows))}
    for i, a in enumerate(rows):
        for j in range(i):
            b = rows[j]
            if usable(a) and usable(b) and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], float), np.array(b[1], float)
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                    links[i].add(j)
                    links[j].add(i)
    out = []
    for i, r in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((r[0], len(links[i]), min(ids) if ids else None))
    return sorted(out, key=str)


def clusters(n, groups, width=16, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, width))
    noise = rng.uniform(0.0, 0.35, n)[:, None] * rng.normal(size=(n, width))
    vectors = centres[rng.integers(0, groups, n)] + noise
    return [(i, v.tolist(), int(rng.integers(0, 3))) for i, v in enumerate(vectors)]


def test_recall_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 16)
    rows = clusters(600, 12)
    got = E.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    want = {v: n for v, n, _ in brute_force(rows)}
    assert len(got) == len(rows)
    assert all(r.n_links <= want[r.vec_id] for r in got)  # none below the threshold, none twice
    assert sum(r.n_links for r in got) >= 0.9 * sum(want.values()) > 0


@pytest.mark.parametrize("share", [1 / 3, 0.9])
def test_recall_with_one_large_family(spark, share):
    """A family of near copies, pairs at about the threshold, among small ones."""
    rng = np.random.default_rng(4)
    n, width = 2400, 64
    centres = rng.normal(size=(n // 4, width))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    hot = rng.random(n) < share
    noise = rng.normal(size=(n, width))
    noise *= np.where(hot, 0.27, 0.2)[:, None] / np.linalg.norm(noise, axis=1, keepdims=True)
    x = centres[np.where(hot, 0, rng.integers(1, n // 4, n))] + noise
    got = E.near_vectors(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], SCHEMA)).collect()
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = (x @ x.T >= 0.93).sum(axis=1) - 1
    assert all(r.n_links <= want[r.vec_id] for r in got)
    assert sum(r.n_links for r in got if hot[r.vec_id]) >= 0.95 * want[hot].sum() > 0


def test_dirty_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0, 0.0], 0), (2, [2.0, 0.0, 0.0], 0), (2, [2.0, 0.0, 0.0], 0), (3, [1.0, 0.0, 0.0], 1),
        (4, None, 0), (5, [], 0), (6, [0.0, 0.0, 0.0], 0), (7, [1.0, None, 0.0], 0), (8, [1.0, nan, 0.0], 0),
        (9, [1.0, inf, 0.0], 0), (10, [1.0, 0.0, 0.0], None), (11, [1.0, 0.0], 0), (12, [1.0, 0.01], 0),
        (None, [0.0, 1.0, 0.0], 0), (13, [0.0, 1.0, 0.0], 0), (14, [1e-300, 0.0, 0.0], 0), (15, [1e300, 0.0, 0.0], 0),
        (16, [-1.0, 0.0, 0.0], 0),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", node string")
    got = E.near_vectors(df).collect()
    scaled = [(a, [x / 1e300 for x in v] if a == 15 else [x * 1e300 for x in v] if a == 14 else v, c) for a, v, c in rows]
    assert sorted([(r.vec_id, r.n_links, r.component_id) for r in got], key=str) == brute_force(scaled)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)


def test_empty_table(spark):
    assert E.near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("n", [1, 2, 50])
def test_copies_and_few_vectors(spark, n):
    rows = [(i, [0.5, -1.0], 7) for i in range(n)]
    got = E.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(n - 1, 0)} and sum(r.kept for r in got) == 1


def test_query_on_a_table(spark, sf0001):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf0001}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = Q.QUERIES["op1_pivot_near_vectors"](spark, sf0001).collect()
    assert len(got) == len(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
