import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from marquee.llm import queries as Q
from marquee.llm import token_files as R

WORD = public_tokenizers.path("word_bpe_49k.json")


def test_rounds_go_on_while_pairs_are_frequent():
    ids = np.tile(np.arange(1024), 20).astype("<u4")
    rules, lengths, symbols = R.repair(ids)
    assert (R.expand(rules, symbols) == ids).all()
    assert lengths.max() >= 1024 and len(symbols) < 20


@pytest.mark.parametrize("seed", range(5))
def test_grammar_round_trip(seed):
    rng = np.random.default_rng(seed)
    phrases = [rng.integers(0, 60, rng.integers(2, 9)) for _ in range(12)]
    ids = np.concatenate([phrases[i] for i in rng.integers(0, 12, 4000)]).astype("<u4")
    rules, lengths, symbols = R.repair(ids)
    assert (R.expand(rules, symbols) == ids).all()
    assert len(symbols) < len(ids) / 3 and len(rules)
    for r in range(len(rules)):
        assert len(R.expand(rules, np.array([R.FIRST_RULE + r]))) == lengths[r]


@pytest.mark.parametrize("ids", [[], [5], [7] * 1001, [1, 2] * 500 + [1]])
def test_grammar_edges(ids):
    ids = np.array(ids, "<u4")
    rules, _, symbols = R.repair(ids)
    assert R.expand(rules, symbols).tolist() == ids.tolist()


def test_each_rule_is_expanded_once(monkeypatch):
    ids = np.concatenate([np.tile(np.arange(500), 40), np.arange(7000, 9000), np.full(999, 3)]).astype("<u4")
    rules, lengths, symbols = R.repair(ids)
    assert R.expand(rules, symbols, lengths).tolist() == ids.tolist()
    one = np.array([R.FIRST_RULE + len(rules) - 1, 5])
    assert R.expand(rules, one, lengths).tolist() == R.expand(rules, one).tolist()
    handed, whole = [], R.expand
    monkeypatch.setattr(R, "expand", lambda r, s, lengths=None: handed.append(len(s)) or whole(r, s, lengths))
    words = np.tile([1, 2, 3, 4], 5000).astype("<u4")
    rules, lengths, _ = R.repair(words)
    symbols = np.repeat([R.FIRST_RULE + len(rules) - 1, 9], 4000)
    whole(rules, symbols, lengths)
    assert handed == [len(rules)]


def test_frequent_pairs_of_one_bin():
    far = 7 + (1 << 20)
    assert R._bins(np.array([5]), np.array([7])) == R._bins(np.array([5]), np.array([far]))
    ids = np.tile([5, 7, 5, far, 5, 7, 9, 5, far, 5, far + (1 << 20)], 30).astype("<u4")
    rules, lengths, symbols = R.repair(ids)
    assert R.expand(rules, symbols, lengths).tolist() == ids.tolist()
    assert len(symbols) < len(ids) / 5


def expected(rows):
    tokenizer = Tokenizer.from_file(WORD)
    out, start = [], 0
    for r in sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0)):
        ids = np.array(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4")
        out.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_dirty_rows(spark, dirty):
    rows = dirty.collect()
    got = R.read_token_files(R.write_token_files(dirty, WORD, block_ids=64)).collect()
    want = expected(rows)
    starts = sorted((r.start, r.n_tokens) for r in got)
    assert sum(n for _, n in starts) == sum(x[2] for x in want)
    at = 0
    for start, n in starts:
        assert start == at
        at += n
    key = lambda doc_id, n, crc: (str(doc_id), n, crc)  # noqa: E731  rows of one id may change places
    assert sorted(key(r.doc_id, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in got) == sorted(
        key(d, n, c) for d, _, n, c in want)
    ordered = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ordered == [x[0] for x in want]


def test_one_document_without_the_rest(spark, sf0001):
    docs = spark.read.parquet(f"{sf0001}/documents.parquet")
    manifest = R.write_token_files(docs, WORD)
    whole = {r.doc_id: bytes(r.ids) for r in R.read_token_files(manifest).collect()}
    for row in manifest.collect():
        system, place = R._open(row["file"])
        sizes = (row["rules"], row["symbols"], row["docs"])
        with system.open_input_file(place) as f:
            block = R.Block(f.read_at(R.Block.size(*sizes), row["at"]), *sizes)
        for i in range(0, row["docs"], 7):
            assert block.document(i).tobytes() == whole[int(block.doc_ids[i])]


def test_empty_table(spark, no_docs):
    assert R.read_token_files(R.write_token_files(no_docs, WORD)).collect() == []


def test_query_on_a_table(spark, sf0001):
    docs = spark.read.parquet(f"{sf0001}/documents.parquet").collect()
    got = Q.QUERIES["op3_repair_token_files"](spark, sf0001).collect()
    assert sorted(map(tuple, got)) == expected(docs)
