import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marquee.llm import packing as P
from marquee.llm import queries as Q
from marquee.llm import tokens
from marquee.llm.tokens import Encoder

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


@pytest.fixture(scope="module", params=[BYTE, WORD])
def pair(request):
    return Encoder(request.param), Tokenizer.from_file(request.param)


def same(pair, text):
    return np.frombuffer(pair[0].encode(text), "<u4").tolist() == pair[1].encode(text, add_special_tokens=False).ids


def test_words_marks_and_old_pieces(pair, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_LIMIT", 5)
    words = ["plain", "İstanbul", "Straße", "ﬁne", "ΣΑΣ", "naïve", "中文字", "e\u0301t", "don't", "x1", "", "ǅ", "ᾳ", "İİ"]
    for w in words * 2:
        assert same(pair, " ".join([w, *words, w + ",", w.upper() + ".", w + "?!"]))


@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet=st.sampled_from("ab'sT1 ,.\n\t ́é　\x1c\x85\U0001f600ΣßİǅⅫ½<|>endoftx"), max_size=40))
def test_piecewise_ids_equal_whole_text_ids(pair, text):
    assert same(pair, text)


@settings(max_examples=200, deadline=None)
@given(text=st.text(max_size=60))
def test_piecewise_ids_on_any_text(pair, text):
    assert same(pair, text)


def test_a_word_is_encoded_once_with_any_marks_and_lines(pair):
    encoder = Encoder(WORD if pair[0].tail.folds else BYTE)
    texts = ["a zebra zebra, zebra. zebra*** x\nzebra\nzebra? zebra", None, "", "a zebra!?", "  zebra \n zebra$$$"] * 3
    got = [np.frombuffer(ids, "<u4").tolist() for ids in encoder.encode_all(pa.array(texts, pa.string()))]
    assert got == [pair[1].encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [p for p in encoder.tail if "zebra" in p] == ["zebra"]


@settings(max_examples=100, deadline=None)
@given(texts=st.lists(st.text(alphabet=st.sampled_from("aab'sT1 ,.*   \n\t ́é　\x1c\x85\U0001f600ΣßİǅⅫ½<|>endoftx"), max_size=40)))
def test_ids_of_many_texts_at_once(pair, texts):
    got = [np.frombuffer(ids, "<u4").tolist() for ids in pair[0].encode_all(pa.array(texts, pa.string()))]
    assert got == [pair[1].encode(t, add_special_tokens=False).ids for t in texts]


def test_many_texts_in_small_parts(pair, monkeypatch):
    monkeypatch.setattr(tokens, "BYTES_AT_ONCE", 30)
    monkeypatch.setattr(tokens, "CACHE_LIMIT", 3)
    texts = [None, "one two, two.\nThree", "Straße naïve*** ", "x" * 100, "", "one\n\ntwo <b>\nthree"] * 4
    column = pa.array([None, "cut off", *texts]).slice(2)
    got = [np.frombuffer(ids, "<u4").tolist() for ids in pair[0].encode_all(column)]
    assert got == [pair[1].encode(t or "", add_special_tokens=False).ids for t in texts]


def test_piecewise_ids_of_accents_marks_and_line_breaks(pair):
    rng = random.Random(3)
    latin = [chr(c) for c in range(0xC0, 0x250)]
    usual = list("abcXYZ'.,;:!?-<| \n\t1") + ["\n", "\n", " ", " ", "\u0301", "\u0307", "\u03a3"]
    for _ in range(30_000):
        text = "".join(rng.choice(usual if rng.random() < 0.7 else latin) for _ in range(rng.randint(1, 14)))
        assert same(pair, text), text


def test_a_word_a_line_for_many_lines(pair):
    assert same(pair, "\n".join(f"word{'abcdefg'[i % 7]}." for i in range(30_000)))


def test_a_task_that_is_done_remembers_no_words():
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["some words, words\nlines", None])], names=["doc_id", "text"])
    (out,) = P._cut(BYTE, 2, 1024)(iter([batch]))
    known = tokens.encoder(BYTE)
    assert out.num_rows == 2 and not (known.tail or known.head or known.tail.old or known.head.old)


def check(rows, texts, capacity=1024):
    tokenizer = Tokenizer.from_file(BYTE)
    ids = [tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for _, t in texts]
    want, total = [], 0
    for (doc_id, _), one in zip(texts, ids, strict=True):
        total += len(one)
        length, start, piece = len(one) % capacity or capacity, 0, 0
        while start < len(one):
            part = np.array(one[start : start + length], "<u4").tobytes()
            want.append((doc_id, piece, start, length, zlib.crc32(part)))
            start, piece, length = start + length, piece + 1, capacity
    assert sorted([tuple(r[:5]) for r in rows], key=str) == sorted(want, key=str)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), total


def packed(docs, **more):
    return P.pack(docs, BYTE, content={"ids_crc32": F.crc32("ids")}, **more).collect()


def test_dirty_rows(spark, dirty):
    texts = [(r.doc_id, r.text) for r in dirty.collect()]
    n, total = check(packed(dirty), texts)
    assert n <= -(-total // 1024) + 1
    check(packed(dirty, capacity=7), texts, 7)


def test_empty_table(spark, no_docs):
    assert packed(no_docs) == []


def test_query_is_near_the_bound(spark, sf0001):
    docs = spark.read.parquet(f"{sf0001}/documents.parquet").collect()
    rows = Q.QUERIES["op2_best_fit_packing"](spark, sf0001).collect()
    n, total = check(rows, [(r.doc_id, r.text) for r in docs])
    assert n <= 1.02 * total / 1024 + 1


def test_sequences_hold_the_ids(spark, dirty):
    rows = P.pack(dirty, BYTE)
    joined = {r.sequence_id: bytes(r.ids) for r in P.sequences(rows).collect()}
    for r in rows.collect():
        assert joined[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == bytes(r.ids)


def test_fullest_is_the_best_subset_sum():
    rng = random.Random(5)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(rng.randint(1, 6))}
        room = rng.randint(0, 60)
        sums = {0}
        for length, n in counts.items():
            sums = {s + k * length for s in sums for k in range(n + 1)}
        found = P.fullest(counts, room)
        assert sum(k * n for k, n in found.items()) == max(s for s in sums if s <= room)
        assert all(n <= counts[k] for k, n in found.items())


def test_plan_uses_every_piece_once_in_few_steps():
    rng = np.random.default_rng(1)
    counts = {int(k): int(n) for k, n in zip(*np.unique(rng.integers(1, 1025, 200_000), return_counts=True), strict=True)}
    bins = P.plan(counts, 1024)
    used = {}
    for combination, times in bins:
        assert sum(k * n for k, n in combination.items()) <= 1024
        for k, n in combination.items():
            used[k] = used.get(k, 0) + n * times
    assert used == counts
    total = sum(k * n for k, n in counts.items())
    assert sum(t for _, t in bins) <= 1.001 * total / 1024 + 2
    assert len(bins) < 8000  # depends on the lengths, not on how many pieces there are
