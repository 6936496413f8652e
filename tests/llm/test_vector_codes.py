import hashlib
import math
from collections import Counter

import duckdb
import numpy as np
import pytest

from marquee.llm import queries as Q
from marquee.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<double>, label int"
CLASHES = ["vector", "code", "error", "label_error", "_rows", "_salt", "_hot", "_label", "ids", "values"]


def floor(x, scale):
    return int(x) * scale if abs(x) >= 2**53 else math.floor(x * scale)


def brute_force(rows, parts=16, entries=64, rounds=2, scale=256):
    """Plain Lloyd rounds on lists of Python integers."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    if not kept:
        return []
    widths = Counter(len(r[1]) for r in kept)
    width = max(widths, key=lambda w: (widths[w], w))
    fit = [(r[0], [floor(x, scale) for x in r[1]], r[2], r[1]) for r in kept if len(r[1]) == width]
    ends = V.part_bounds(width, parts)
    first = sorted(fit, key=lambda r: (r[0] is None, r[0] or 0, r[3]))[:entries]
    books = [[f[1][a:b] for f in first] for a, b in zip(ends, ends[1:])]

    def nearest(part, book):
        d = [sum((x - y) ** 2 for x, y in zip(part, e)) for e in book]
        return min(range(len(d)), key=lambda i: (d[i], i)), min(d)

    for _ in range(rounds):
        for p, (a, b) in enumerate(zip(ends, ends[1:])):
            mine = {}
            for r in fit:
                mine.setdefault(nearest(r[1][a:b], books[p])[0], []).append(r[1][a:b])
            for e, vectors in mine.items():
                books[p][e] = [sum(c) // len(vectors) for c in zip(*vectors)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = []
    for r in fit:
        near = [nearest(r[1][a:b], books[p]) for p, (a, b) in enumerate(zip(ends, ends[1:]))]
        out.append((r[0], r[2], "".join(f"{i:02x}" for i, _ in near), min(sum(d for _, d in near), 2**63 - 1)))
    out += [(r[0], r[2], None, None) for r in kept if len(r[1]) != width]
    totals = Counter()
    for r in out:
        totals[r[1]] += r[3] or 0
    return sorted([(*r, min(totals[r[1]], 2**63 - 1), digest) for r in out], key=str)


def run(df, **options):
    got = V.vector_codes(df, **options).select("vec_id", "label", "code", "error", "label_error", "codebooks_sha256")
    return sorted((tuple(r) for r in got.collect()), key=str)


@pytest.mark.parametrize("width,options", [
    (16, {}), (32, {"entries": 5}), (12, {"parts": 5, "entries": 7, "rounds": 3}), (3, {"entries": 4, "rounds": 0})])
def test_against_brute_force(spark, monkeypatch, width, options):
    monkeypatch.setattr(V, "BLOCK", 37)
    rng = np.random.default_rng(width)
    x = rng.normal(size=(300, width)).round(1) * rng.choice([0.01, 1, 1], 300)[:, None]
    rows = [(int(i), v.tolist(), None if i % 7 == 0 else int(i % 3 > 0)) for i, v in zip(rng.permutation(300), x)]
    assert run(spark.createDataFrame(rows, SCHEMA).repartition(4), **options) == brute_force(rows, **options)


def test_dirty_rows(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=16).tolist(), i % 2) for i in range(90)]
    rows += [(5, rows[5][1], 1), (5, rows[6][1], 1), (None, rows[7][1], None), (None, rows[8][1], 3)]
    rows += [(200, None, 0), (201, [], 0), (202, [1.0], 7), (203, [None] * 16, 0), (204, [nan] * 16, 0), (205, [inf] + [0.0] * 15, 0)]
    rows += [(206, [0.0] * 16, None), (207, [-1e-9] * 16, None)]
    df = spark.createDataFrame([(*r, *["x"] * len(CLASHES)) for r in rows], SCHEMA + "".join(f", {c} string" for c in CLASHES))
    got = run(df.repartition(3))
    assert got == brute_force(rows)
    assert {r[0] for r in got if r[2] is None} == {201, 202}


@pytest.mark.parametrize("size", [1e9, 1e15, 1.7e308])
def test_large_values_stay_exact(spark, size):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.uniform(-1, 1, 16) * size).tolist(), 0) for i in range(80)]
    assert run(spark.createDataFrame(rows, SCHEMA)) == brute_force(rows)


@pytest.mark.parametrize("n", [0, 1, 70])
def test_few_rows_and_copies(spark, n):
    rows = [(i, [0.5, -1.0] * 8, None) for i in range(n)]
    assert run(spark.createDataFrame(rows, SCHEMA)) == brute_force(rows)


def test_hot_and_many_labels(spark):
    """A label with most of the rows is split; totals stay those of equal labels."""
    rows = [(i, [float(i % 11)] * 16, None if i % 2 else i) for i in range(400)]
    assert run(spark.createDataFrame(rows, SCHEMA).repartition(5)) == brute_force(rows)


def test_every_distinct_integer_is_tabulated_once():
    row = {"ids": [1, 2, 3], "labels": [0, 0, 0], "sizes": [2, 1], "values": ["-3", "5", "7"],
           "codes": np.array([[0, 1, 0], [0, 0, 0]], "<u2").tobytes()}
    block = V.Block(row, 2)
    best, distance = block.nearest(V.Codebook([np.array([[5, 7], [-3, 8], [5, 7]])]), 0)
    assert best.tolist() == [1, 0, 1] and distance.tolist() == [1, 0, 1] and distance.dtype == np.int32


def test_oracle_sql_and_query_on_a_table(spark, sf0001):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf0001}/embeddings.parquet')")
    want = con.execute(Q.ORACLE_SQL["op12_vector_codes"])
    names = [c[0] for c in want.description]
    want = sorted(want.fetchall(), key=str)
    got = Q.QUERIES["op12_vector_codes"](spark, sf0001).select(*names)
    assert want and sorted((tuple(r) for r in got.collect()), key=str) == want
