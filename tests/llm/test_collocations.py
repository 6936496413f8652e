import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from marquee.llm import collocations as C
from marquee.llm import queries as Q

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_force(rows, least, top):
    """Every phrase counted, by the definition; Python's integers."""
    counts, sizes = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            words = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            mine = counts.setdefault(lang, Counter())
            for m in range(1, 6):
                mine.update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, mine in counts.items():
        often = {p: a for p, a in mine.items() if len(p) > 1 and a >= least}
        inside = set()
        for p, a in often.items():
            for m in range(2, len(p)):
                inside |= {q for i in range(len(p) - m + 1) if 100 * a >= 100 * mine[q := p[i : i + m]]}
        scored = []
        for p, a in often.items():
            if p not in inside:
                n = sizes[lang]
                cuts = [(1000 * a * n // (mine[p[:k]] * mine[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                scored.append((-score, -a, " ".join(p).encode(), mine[p[:k]], mine[p[k:]], n))
        for rank, (score, a, p, left, right, n) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -score))
    return sorted(out)


def run(spark, rows, **options):
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    return sorted(tuple(r) for r in C.collocations(docs, **options).collect())


def corpus(seed, texts=60, vocabulary=40, marks=" ,\n.\t "):
    """Few words, fixed sayings and words that follow only one other."""
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    weights = 1 / np.arange(1, vocabulary + 1)
    rows = []
    for i in range(texts):
        out = []
        for _ in range(rng.integers(1, 120)):
            kind = rng.integers(0, 12)
            if kind == 0:
                out.append("New York stock Exchange opens")
            elif kind == 1:
                out.append("out of the blue"[: rng.integers(6, 16)])
            else:
                out.append(rng.choice(words, p=weights / weights.sum()))
            out.append(" " if rng.random() < 0.8 else rng.choice(list(marks)))
        rows.append(("".join(out), [None, "en", "de"][i % 3]))
    return rows


@pytest.mark.parametrize("seed,least,top", [(0, 5, 2000), (1, 5, 20), (3, 3, 1)])
def test_against_brute_force(spark, seed, least, top):
    rows = corpus(seed)
    want = brute_force(rows, least, top)
    assert want and run(spark, rows, least=least, top=top) == want


@pytest.mark.parametrize("top", [1, 20])
def test_words_that_are_grown_late_and_parts_counted_on_demand(spark, monkeypatch, top):
    """Heavy first words stay closed when their bound is too low; what a score needs of them is counted all the same."""
    monkeypatch.setattr(C, "HEAVY", 12)
    rng = np.random.default_rng(9)
    rows = []
    for _ in range(150):
        out = []
        for _ in range(40):
            out.append(["a", "a", "a", "b", "b", f"x{rng.integers(0, 300)}", "port of call", "head of a state"][rng.integers(0, 8)])
        rows.append((" ".join(out), "en"))
    want = brute_force(rows, 10, top)
    assert any(" of " in r[2] for r in want)
    assert run(spark, rows, least=10, top=top) == want


def test_small_chunks_and_full_filters_change_nothing(spark, monkeypatch):
    rows = corpus(5)
    want = brute_force(rows, 5, 30)
    monkeypatch.setattr(C, "CHUNK", 300)
    monkeypatch.setattr(C, "FILTER_BITS", 1 << 12)
    docs = spark.createDataFrame(rows, "text string, lang string")
    assert sorted(tuple(r) for r in C.collocations(docs, least=5, top=30).collect()) == want


def test_ties_cross_the_end_in_byte_order(spark):
    rows = [(f"{a}{i} {b}{i}", "en") for i in range(9) for a, b in [("é", "z"), ("Z", "\U0001f600"), ("|", "~")] for _ in range(3)]
    want = brute_force(rows, 3, 11)
    assert run(spark, rows, least=3, top=11) == want and len(want) == 11


def test_dirty_rows(spark, dirty):
    rows = [(r.text, r.lang) for r in dirty.collect()]
    want = brute_force(rows, 2, 50)
    got = sorted(tuple(r) for r in C.collocations(dirty, least=2, top=50).collect())
    assert got == want and {r[0] for r in want} == {"en"}
    assert brute_force(rows, 1, 9) == sorted(tuple(r) for r in C.collocations(dirty, least=1, top=9).collect())


def test_empty_table(spark, no_docs):
    assert C.collocations(no_docs).collect() == []
    blank = spark.createDataFrame([(None, "en"), ("", None), (" ,. ", "en")], "text string, lang string")
    assert C.collocations(blank).collect() == []


def test_filters_never_miss(spark):
    phrases = [("en", " ".join(f"w{i}" for i in range(j, j + 1 + j % 4))) for j in range(500)]
    rows = [("k", len(p.split()), lang, p) for lang, p in phrases]
    made = C.phrase_filters(spark.createDataFrame(rows, "kind string, words int, lang string, phrase string"))
    chunk = C.Chunk([f"{p};".encode() for _, p in phrases], [x.encode() for x, _ in phrases])
    chunk.hashed()
    starts = np.flatnonzero(np.diff(np.concatenate([[-1], chunk.piece])))
    for start, (_, p) in zip(starts, phrases, strict=True):
        assert made["k", len(p.split())].has(chunk.phrase_hash(np.array([start]), len(p.split()))).all()


def test_oracle_sql_on_a_table(spark, sf0001):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf0001}/documents.parquet')")
    want = sorted(con.execute(Q.ORACLE_SQL["op11_collocations"]).fetchall())
    assert want and sorted(tuple(r) for r in Q.QUERIES["op11_collocations"](spark, sf0001).collect()) == want
