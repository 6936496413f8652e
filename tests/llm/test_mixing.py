import re

import duckdb

from marquee.llm import mixing as M
from marquee.llm import queries as Q


def targets(sums, weights=(5, 2, 1), budget=1.5, cap=2.0):
    names = sorted((k for k in sums if k is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sums else [])
    w = {k: weights[i % len(weights)] for i, k in enumerate(names)}
    full, left = set(), budget * sum(sums.values())
    while True:
        free = [k for k in names if k not in full]
        if not free:
            return {k: cap * sums[k] for k in names}
        level = (left - sum(cap * sums[k] for k in full)) / sum(w[k] for k in free)
        more = {k for k in free if w[k] * level >= cap * sums[k]}
        if not more:
            return {k: cap * sums[k] if k in full else w[k] * level for k in names}
        full |= more


def check(rows, docs):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sums = {}
    for r in docs:
        sums[r.source] = sums.get(r.source, 0) + size(r.text)
    want = targets(sums)
    assert sorted(((r.doc_id, r.size) for r in rows), key=str) == sorted(((r.doc_id, size(r.text)) for r in docs), key=str)
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    by_size = {}
    for r in rows:
        by_size.setdefault((r.source_size, r.target), 0)
        by_size[(r.source_size, r.target)] += r.taken
    assert {round(t, 6) for _, t in by_size} == {round(v, 6) for v in want.values()}
    for (source_size, target), taken in by_size.items():
        same = [k for k in want if sums[k] == source_size and abs(want[k] - target) < 1e-6]
        assert abs(taken - len(same) * target) <= len(same)


def test_dirty_rows(spark, dirty):
    check(M.mixed_documents(dirty).collect(), dirty.collect())


def test_query_and_rerun(spark, sf0001):
    docs = spark.read.parquet(f"{sf0001}/documents.parquet").collect()
    rows = Q.QUERIES["op6_source_mixing"](spark, sf0001).collect()
    check(rows, docs)
    assert sorted(rows) == sorted(Q.QUERIES["op6_source_mixing"](spark, sf0001).collect())


def test_schedule_is_complete_and_even(spark, sf0001):
    docs = spark.read.parquet(f"{sf0001}/documents.parquet")
    sized = M.sized_documents(docs)
    found = M.written(M.source_targets(sized), "targets")
    pieces = M.mix(M._ranked(sized, found).select("row", "doc_id", "source_rank", "size"), found).collect()
    blocks = {}
    for p in pieces:
        blocks.setdefault((p.source_rank, p.block), []).append(p)
    slots = {k: {p.slot for p in v} for k, v in blocks.items()}
    assert all(len(s) == 1 for s in slots.values())  # one place in time for a block
    order = sorted((next(iter(s)), k) for k, s in slots.items())
    assert len({t for t, _ in order}) == len(order)
    assert all(sum(p.words for p in v) <= M.BLOCK for v in blocks.values())
    # Every source has its share of any stretch of the schedule, to a few slots.
    total = {}
    for _, (source, _) in order:
        total[source] = total.get(source, 0) + 1
    for share in (0.25, 0.5, 0.75):
        part = [k[0] for _, k in order[: int(share * len(order))]]
        for source, n in total.items():
            assert abs(part.count(source) - share * n) <= 10
    # Ranks of a source's blocks ascend in time.
    for source in total:
        ranks = [k[1] for _, k in order if k[0] == source]
        assert ranks == sorted(ranks) == list(range(len(ranks)))


def test_corpus_holds_the_words_taken(spark, sf0001, dirty):
    for docs in (spark.read.parquet(f"{sf0001}/documents.parquet"), dirty):
        mixed = M.mixed_corpus(docs)
        assert mixed.dtypes == docs.dtypes
        count = lambda df: df.select(M.word_count(df["text"]).alias("n")).groupBy().sum("n").first()[0]
        taken = sum(r.taken for r in M.mixed_documents(docs).collect())
        assert count(mixed) == taken


def test_empty_table(spark, no_docs):
    assert M.mixed_documents(no_docs).collect() == []
    assert M.mixed_corpus(no_docs).collect() == []


def test_any_stretch_in_slot_order_has_the_weights(spark, sf001):
    """Documents read by their first slot: each tenth of the words taken has every source near its share."""
    rows = M.mixed_documents(spark.read.parquet(f"{sf001}/documents.parquet").select("doc_id", "text", "source"))
    rows = rows.join(spark.read.parquet(f"{sf001}/documents.parquet").select("doc_id", "source"), "doc_id")
    rows = sorted(((r.first_slot, r.source, r.taken, r.size, r.n_slots) for r in rows.collect() if r.taken), key=lambda r: r[0])
    total = sum(r[2] for r in rows)
    longest = max(r[2] for r in rows)
    share = {s: sum(r[2] for r in rows if r[1] == s) / total for s in {r[1] for r in rows}}
    assert all(r[4] >= -(-r[2] // M.BLOCK) for r in rows)
    blocks = {}
    done = 0
    for _, source, taken, *_ in rows:
        done += taken
        tenth = min(9, 10 * done // total)
        blocks.setdefault(tenth, {}).setdefault(source, 0)
        blocks[tenth][source] += taken
    for held in blocks.values():
        n = sum(held.values())
        for source, want in share.items():
            assert abs(held.get(source, 0) - want * n) <= 0.05 * n + 2 * longest, (source, want, held)


def test_sql_gives_the_same(spark, sf0001):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf0001}/documents.parquet'")
    want = con.execute(M.ORACLE).df().sort_values("doc_id")
    got = M.mixed_documents(spark.read.parquet(f"{sf0001}/documents.parquet")).toPandas().sort_values("doc_id")
    assert got[want.columns].fillna(-1).to_numpy().tolist() == want.fillna(-1).to_numpy().tolist()


def test_the_corpus_is_planned_in_steps(spark, sf0001):
    """The last plan reads the documents and the words taken of each, once for either part of the union: the
    driver holds all stages of a plan at once."""
    plan = M.mixed_corpus(spark.read.parquet(f"{sf0001}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 4, plan


def test_texts_move_alike_at_any_size(spark, sf0001):
    """What is taken is not broadcast while it is small: the disk of the stage grows as its input."""
    plan = M.mixed_corpus(spark.read.parquet(f"{sf0001}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ShuffledHashJoin [row") == 2 and "Broadcast" not in plan, plan
