import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from marquee.llm import queries as Q
from marquee.llm import substring_dedup as S

PASSAGE = ("The old harbour lies behind the hill. Every morning the boats leave before the sun is up! Nobody on "
           "the quay says a word until they are gone. Then the market opens and the noise begins for the day. "
           "By noon the stalls are empty again, and the gulls take over what is left of it.")


def spans(text):
    """Every run that the rules call a span, found without sliding."""
    parts = [re.findall(r"\w+", s.lower()) for s in S.sentences(text)]
    full = [i for i, p in enumerate(parts) if p]

    def enough(i, j):
        inner = [x for x in full if i <= x <= j]
        n = sum(len(parts[x]) for x in inner)
        return n >= S.LEAST_WORDS and (len(inner) >= S.LEAST_SENTENCES or n >= S.ALONE_WORDS)

    out = set()
    for i in full:
        ends = [j for j in full if j >= i and enough(i, j)]
        if ends:
            out.add((i, ends[0]))
    for j in full:
        starts = [i for i in full if i <= j and enough(i, j)]
        if starts:
            out.add((starts[-1], j))
    return {(i, j, " ".join(w for p in parts[i : j + 1] for w in p)) for i, j in out}


def brute_force(rows):
    order = sorted(range(len(rows)), key=lambda i: (rows[i].doc_id is None, rows[i].doc_id or 0, i))
    first, removed = {}, {i: set() for i in range(len(rows))}
    for i in order:
        for a, b, words in sorted(spans(rows[i].text or "")):
            if words in first:
                removed[i] |= set(range(a, b + 1))
            else:
                first[words] = (i, a, b)
    return sorted([(r.doc_id, len(S.sentences(r.text or "")), sorted(removed[i])) for i, r in enumerate(rows)], key=str)


def result(df):
    return sorted([(r.doc_id, r.n_sentences, list(r.removed)) for r in df.collect()], key=str)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .!?\n1。,;", max_size=60))
def test_sentences_are_all_of_the_text(text):
    assert "".join(S.sentences(text)) == text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 45), max_size=12))
def test_sliding_finds_every_span(sizes):
    text = " ".join(" ".join(f"w{i}x{j}" for j in range(n)) + "." for i, n in enumerate(sizes))
    assert {(a, b) for a, b, _ in S.spans(text, S.LEAST_SENTENCES, S.LEAST_WORDS, S.ALONE_WORDS)} == {
        (a, b) for a, b, _ in spans(text)}


def test_passage_in_other_company(spark):
    rows = [(1, "First things come first here. " + PASSAGE + " Something else follows it at once."),
            (2, "A different opening line stands there.\n" + PASSAGE + "\nAnd another end."),
            (3, PASSAGE.upper() + " Only the case is changed in this one."), (4, "Nothing of the kind. Short.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in S.repeated_sentences(df).collect()}
    assert got[1].clean_text == rows[0][1] and got[4].clean_text == rows[3][1]
    assert got[2].clean_text == "A different opening line stands there.\nAnd another end."
    assert got[3].clean_text == "Only the case is changed in this one."


def test_planted_passages_inside_sentences(spark):
    """51 words without a mark, or with marks elsewhere, in the middle of other sentences."""
    words = [f"w{i}" for i in range(51)]
    marked = " ".join(w + ("," if i in (17, 34) else "") for i, w in enumerate(words))
    own = [" ".join(f"d{d}x{i}" for i in range(30)) for d in range(4)]
    rows = [(d, f"{own[d]} {p} {own[d][::-1]}.") for d, p in enumerate([" ".join(words), " ".join(words), marked, " ".join(words[1:50])])]
    got = {r.doc_id: r.clean_text for r in S.repeated_sentences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: rows[0][1], 1: f"{own[1]} {own[1][::-1]}.", 2: f"{own[2]} {own[2][::-1]}.", 3: rows[3][1]}


def cut_by_hand(rows):
    """clean_text: the sentences of repeated spans and all windows that occurred before, one by one."""
    n, order = S.RUN_WORDS, sorted(range(len(rows)), key=lambda i: (rows[i].doc_id is None, rows[i].doc_id or 0, i))
    seen, first, out = {}, {}, [None] * len(rows)
    for i in order:
        text = rows[i].text
        if text is None:
            continue
        gone, ends = set(), np.cumsum([0] + [len(x) for x in S.sentences(text)])
        for a, b, words in sorted(spans(text)):
            if words in first:
                gone |= set(range(ends[a], ends[b + 1]))
            else:
                first[words] = True
        places = [m.span() for m in S._WORDS.finditer(text)]
        words = [text[a:b].lower() for a, b in places]
        for at in range(len(words) - n + 1):
            of, there = seen.setdefault(tuple(words[at : at + n]), (i, at))
            if of != i or at >= there + n:
                gone |= set(range(places[at][0], S._AFTER.match(text, places[at + n - 1][1]).end()))
        out[i] = "".join(c for k, c in enumerate(text) if k not in gone)
    return sorted(([r.doc_id, out[i]] for i, r in enumerate(rows)), key=str)


def cut(df):
    return sorted(([r.doc_id, r.clean_text] for r in df.collect()), key=str)


def test_clean_text_against_brute_force(spark):
    """Pieces of one another, cut anywhere, joined again, doubled, and marked otherwise."""
    draw, docs = random.Random(5), []
    for d in range(60):
        words = [draw.choice(["", "É"]) + f"w{draw.randrange(4000)}" + draw.choice([" ", " ", " ", ", ", ". ", "\n"]) for _ in range(draw.randrange(150))]
        for _ in range(draw.randrange(5)):
            if docs:
                old = draw.choice(docs)
                a = draw.randrange(len(old) + 1)
                piece = old[a : a + draw.randrange(140)]
                if draw.random() < 0.3:
                    piece = [re.sub(r"\W+$", draw.choice([" ", "; "]), w).upper() for w in piece]
                at = draw.randrange(len(words) + 1)
                words[at:at] = piece * draw.choice([1, 1, 2])
        docs.append(words)
    rows = [(d % 50, "".join(w)) for d, w in enumerate(docs)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(1).sortWithinPartitions("doc_id", "text")
    rows = df.collect()
    found = S.repeated_sentences(df)
    assert result(found) == brute_force(rows)
    assert cut(found) == cut_by_hand(rows)


def test_cuts_say_what_goes(spark, sf0001):
    """``clean_text`` is the text without ``cuts``, which hold all sentences of ``removed``."""
    docs = spark.read.parquet(f"{sf0001}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    found = S.repeated_sentences(docs).persist()
    rows = found.collect()
    assert cut(found) == cut_by_hand(docs.collect()) and any(r.cuts for r in rows)
    for r in rows:
        text, at, kept = texts[r.doc_id], 0, ""
        for c in r.cuts:
            assert at <= c.start < c.end <= len(text)
            kept, at = kept + text[at : c.start], c.end
        assert kept + text[at:] == (r.clean_text or "")
        ends = np.cumsum([0] + [len(x) for x in S.sentences(text)])
        assert all(any(c.start <= ends[i] and ends[i + 1] <= c.end for c in r.cuts) for i in r.removed)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="aÉ_老 .!?\n\r1。」,;", max_size=60), min_size=1, max_size=4))
def test_texts_are_taken_apart_as_defined(texts):
    p = S._parse(texts)
    for r, text in enumerate(texts):
        ends = p.sentence_ends[p.sentence_rows[r] : p.sentence_rows[r + 1]] - p.starts[r]
        assert ends.tolist() == np.cumsum([len(x) for x in S.sentences(text)]).tolist()
        words = slice(p.word_rows[r], p.word_rows[r + 1])
        found = zip(p.begin[words] - p.starts[r], p.end[words] - p.starts[r], strict=True)
        assert list(found) == [m.span() for m in S._WORDS.finditer(text)]


def test_texts_are_moved_once(spark, sf0001):
    """The joins on the bucketed texts shuffle seeds and starts only."""
    found = S.repeated_sentences(spark.read.parquet(f"{sf0001}/documents.parquet"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "text" not in plan[plan.index("Exchange") :], plan


def test_text_without_spaces(spark):
    """A passage inside a longer line, and one of under 40 stretches on a line of its own."""
    passage = "老港口在山的后面，每天早晨船在日出之前离开。码头上没有人说话，直到它们都走了！然后市场开门，一天的喧闹就开始了。"
    assert S.sentences("他说：「好。」我走了，再见") == ["他说：", "「好。」", "我走了，", "再见"]
    own = [f"{c * 12}。" for c in "甲乙丙丁"]
    rows = [(0, own[0] + passage + own[0]), (1, own[1] + passage + own[1]), (2, passage), (3, own[3])]
    got = {r.doc_id: r for r in S.repeated_sentences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[d].clean_text for d in range(4)] == [rows[0][1], own[1] * 2, "", own[3]]
    assert list(got[1].removed) == list(range(1, 1 + len(S.sentences(passage))))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "C c", "d."]), max_size=80), st.integers(2, 30))
def test_equal_windows_share_a_least_hash(parts, n):
    words = [w.lower() for w in re.findall(r"\w+", " ".join(parts))]
    p = S._parse([" ".join(parts)])
    at, least, places = S._windows(p, n, np.zeros(len(words), bool))
    windows = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
    assert at.tolist() == list(range(len(windows))) and len(least) == len(windows)
    assert len(set(p.hashes(at, at + n).tolist())) == len(set(windows))
    seeds = p.hashes(places, places + min(S.SEED_WORDS, n)).view(np.int64)
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            assert seeds.tolist().count(least[i]) > 1


def test_dirty_rows(spark, dirty):
    got = result(S.repeated_sentences(dirty))
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in brute_force(dirty.collect())]
    assert got == brute_force(dirty.collect())
    texts = {r.doc_id: r.clean_text for r in S.repeated_sentences(dirty).collect()}
    assert texts[3] is None and texts[4] == "" and texts[6] == "one"


def test_empty_table(spark, no_docs):
    assert S.repeated_sentences(no_docs).collect() == []


def test_query_on_a_table(spark, sf0001):
    rows = spark.read.parquet(f"{sf0001}/documents.parquet").collect()
    assert result(Q.QUERIES["op4_sentence_span_dedup"](spark, sf0001)) == brute_force(rows)


def test_spans_are_moved_as_narrow_rows(spark, monkeypatch):
    """All spans meet by hash with two packed numbers besides their row; the packing holds every sentence and word number."""
    from pyspark.sql import functions as F

    from marquee.llm import substring_dedup as M

    columns, write = {}, M.written
    monkeypatch.setattr(M, "written", lambda df, name: columns.setdefault(name, df.columns) and write(df, name))
    text = "One two three four five six seven. Eight nine ten eleven twelve thirteen fourteen. " * 4
    docs = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")
    M.repeated_sentences(docs)
    assert sorted(columns["shared"]) == ["doc_id", "hash", "place", "row", "sentences"]
    top = 2**31 - 1
    rows = spark.createDataFrame([(0, 0), (0, top), (7, 3), (top, 0), (top, top)], "a int, b int")
    pairs = rows.select("a", "b", M._pair("a", "b").alias("p")).select("a", "b", "p", M._first("p").alias("x"), M._second("p").alias("y"))
    got = pairs.orderBy(F.col("p")).collect()
    assert [(r.x, r.y) for r in got] == [(r.a, r.b) for r in got] == [(0, 0), (0, top), (7, 3), (top, 0), (top, top)]


def test_texts_are_stored_once(spark, monkeypatch):
    """Texts are written in one table, by row; what is found of them is written without them."""
    from marquee.llm import substring_dedup as M

    columns = {}
    for name in ("written", "written_by"):
        write = getattr(M, name)
        monkeypatch.setattr(M, name, lambda df, at, *key, write=write: columns.setdefault(at, df.columns) and write(df, at, *key))
    docs = spark.createDataFrame([(1, PASSAGE), (2, "Before. " + PASSAGE), (3, None)], "doc_id long, text string")
    got = sorted(M.repeated_sentences(docs).collect())
    assert [n for n, held in columns.items() if "text" in held] == ["texts"]
    assert [r.clean_text for r in got] == [PASSAGE, "Before. ", None]
