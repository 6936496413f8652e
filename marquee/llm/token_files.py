"""Token ids in grammar-compressed binary files.

Documents are dealt out in ascending order of doc_id; every task writes one file
of blocks.  A block holds the ids of whole documents, compressed by Re-Pair: frequent
pairs of neighbouring symbols are replaced by new symbols, round after round until none is.  Each
round counts all pairs of the block and replaces the most frequent ones together; where
chosen pairs overlap, the left one wins.  Rules and the number of ids that each symbol
expands to are stored, so a document is decoded without the rest of its block.

File format, all numbers little-endian:
  blocks, one after the other:  rules uint32[r, 2]; expansion lengths uint32[r];
    symbols uint32[s]; per document: its doc_id int64[d], whether it has one uint8[d],
    its first id within the block int64[d + 1].
  Symbol ``s`` below 2**24 is the id ``s``; else it is rule ``s - 2**24``.
The place and sizes of every block (and so the file's index) are rows of a manifest,
which Spark commits: files of tasks that failed or ran twice are not in it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import prefix_sum, shuffle_partitions, written
from marquee.llm.tokens import encoder
from marquee.sources.files import scratch_path

FIRST_RULE = 1 << 24
BLOCK_IDS = 1 << 20  # a block ends with the document that reaches so many ids
LEAST_COUNT, MOST_RULES = 8, 4096  # uses that a rule must have; rules a round
MANIFEST = "file string, shard long, block long, at long, rules long, symbols long, docs long, ids long"


def _bins(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (left * 40503 + right * 10007) & 0xFFFFF


def _places(found: np.ndarray, at: np.ndarray, pairs: np.ndarray, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the positions ``at`` those whose pair is in ``found`` (sorted), and where it is there."""
    own = _bins(found >> 32, found & 0xFFFFFFFF)
    slot = np.full(1 << 20, -1, np.int32)
    slot[own] = np.arange(len(found))
    place = slot[bins[at]]
    at, place = at[place >= 0], place[place >= 0].astype(np.int64)
    wanted = pairs[at]
    other = np.flatnonzero(found[place] != wanted)
    # A bin may hold several of them; the slot has the last one.
    again = np.minimum(np.searchsorted(found, wanted[other]), len(found) - 1)
    place[other] = again
    hit = np.ones(len(at), bool)
    hit[other] = found[again] == wanted[other]
    return at[hit], place[hit]


def repair(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rules, expansion lengths, symbols) of a block's ids."""
    symbols, rules = ids.astype(np.int64), np.zeros((0, 2), np.int64)
    lengths = np.zeros(0, np.int64)
    while len(symbols) > 1:  # every round replaces something or is the last
        pairs = symbols[:-1] << 32 | symbols[1:]
        # A pair cannot be frequent unless all pairs of its bin together are.
        bins = _bins(symbols[:-1], symbols[1:])
        busy = (np.bincount(bins, minlength=1 << 20) >= LEAST_COUNT)[bins]
        busy_at = np.flatnonzero(busy)
        found, counts = np.unique(pairs[busy_at], return_counts=True)
        often = counts >= LEAST_COUNT
        found, counts = found[often], counts[often]
        if len(found) > MOST_RULES:
            top = np.argpartition(-counts, MOST_RULES)[:MOST_RULES]
            found = np.sort(found[top])
        if not len(found):
            break
        at, place = _places(found, busy_at, pairs, bins)
        # Of a run of overlapping occurrences every second one is replaced.
        fresh = np.diff(at, prepend=-2) > 1
        run_start = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
        left = (np.arange(len(at)) - run_start) % 2 == 0
        at, place = at[left], place[left]
        new = np.stack([found >> 32, found & 0xFFFFFFFF], axis=1)
        each = np.where(new < FIRST_RULE, 1, 0)
        nested = new >= FIRST_RULE
        each[nested] = lengths[new[nested] - FIRST_RULE]
        symbols = symbols.copy()
        symbols[at] = FIRST_RULE + len(rules) + place
        rules, lengths = np.concatenate([rules, new]), np.concatenate([lengths, each.sum(axis=1)])
        symbols = np.delete(symbols, at + 1)
    return rules.astype("<u4"), lengths.astype("<u4"), symbols.astype("<u4")


def expand(rules: np.ndarray, symbols: np.ndarray, lengths: np.ndarray | None = None) -> np.ndarray:
    """The ids that ``symbols`` stand for.  With the ``lengths`` of the rules' expansions each rule is
    expanded once and then copied, unless all rules together are much longer than the ids."""
    symbols = symbols.astype(np.int64)
    if lengths is not None and len(rules):
        nested = symbols >= FIRST_RULE
        lengths = lengths.astype(np.int64)
        spans = np.ones(len(symbols), np.int64)
        spans[nested] = lengths[symbols[nested] - FIRST_RULE]
        if lengths.sum() <= 2 * spans.sum():
            table = np.concatenate([expand(rules, FIRST_RULE + np.arange(len(rules))), symbols.astype("<u4")])
            begins = len(table) - len(symbols) + np.arange(len(symbols))
            begins[nested] = (np.cumsum(lengths) - lengths)[symbols[nested] - FIRST_RULE]
            inside = np.arange(spans.sum()) - np.repeat(np.cumsum(spans) - spans - begins, spans)
            return table[inside]
    while True:
        nested = symbols >= FIRST_RULE
        if not nested.any():
            return symbols.astype("<u4")
        starts = np.cumsum(1 + nested) - (1 + nested)
        out = np.empty(len(symbols) + nested.sum(), np.int64)
        out[starts] = symbols
        pair = rules[symbols[nested] - FIRST_RULE]
        out[starts[nested]], out[starts[nested] + 1] = pair[:, 0], pair[:, 1]
        symbols = out


class Block:
    """One block read from a file: decode all of it or one document."""

    def __init__(self, data: bytes, rules: int, symbols: int, docs: int):
        cut = np.cumsum([0, 8 * rules, 4 * rules, 4 * symbols, 8 * docs, docs, 8 * (docs + 1)])
        part = [data[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        self.rules = np.frombuffer(part[0], "<u4").reshape(-1, 2)
        self.lengths = np.frombuffer(part[1], "<u4")
        self.symbols = np.frombuffer(part[2], "<u4")
        self.doc_ids = np.frombuffer(part[3], "<i8")
        self.has_id = np.frombuffer(part[4], np.uint8).astype(bool)
        self.starts = np.frombuffer(part[5], "<i8")

    @staticmethod
    def size(rules: int, symbols: int, docs: int) -> int:
        return 12 * rules + 4 * symbols + 9 * docs + 8 * (docs + 1)

    def all_ids(self) -> np.ndarray:
        return expand(self.rules, self.symbols, self.lengths)

    def document(self, i: int) -> np.ndarray:
        """The ids of document ``i``, expanding only the symbols that it covers."""
        nested = self.symbols >= FIRST_RULE
        spans = np.ones(len(self.symbols), np.int64)
        spans[nested] = self.lengths[self.symbols[nested] - FIRST_RULE]
        begins = np.cumsum(spans) - spans
        low = int(np.searchsorted(begins, self.starts[i], side="right")) - 1
        high = int(np.searchsorted(begins, self.starts[i + 1], side="left"))
        first = int(self.starts[i] - begins[low])
        ids = expand(self.rules, self.symbols[low:high])
        return ids[first : first + int(self.starts[i + 1] - self.starts[i])]


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def _write(folder: str, path: str, end_id: int, block_ids: int):
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]):
        known = encoder(path)
        shard = TaskContext.get().partitionId()
        name = f"{folder}/shard-{shard:08d}-{uuid.uuid4().hex}.repair"
        docs, held, sink, at, rows = [], 0, None, 0, []

        def flush():
            nonlocal docs, held, sink, at
            if sink is None:
                system, place = _open(name)
                sink = system.open_output_stream(place)
            ids = np.frombuffer(b"".join(d[1] for d in docs), "<u4")
            rules, lengths, symbols = repair(ids)
            starts = np.cumsum([0] + [len(d[1]) // 4 for d in docs])
            data = b"".join([
                rules.tobytes(), lengths.tobytes(), symbols.tobytes(),
                np.array([d[0] or 0 for d in docs], "<i8").tobytes(),
                bytes(d[0] is not None for d in docs), starts.astype("<i8").tobytes(),
            ])
            sink.write(data)
            rows.append((name, shard, len(rows), at, len(rules), len(symbols), len(docs), len(ids)))
            at, docs, held = at + len(data), [], 0

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), known.encode_all(batch.column(1)), strict=True):
                docs.append((doc_id, ids + end))
                held += len(docs[-1][1]) // 4
                if held >= block_ids:
                    flush()
        if docs:
            flush()
        known.forget()
        if sink is not None:
            sink.close()
            names = ["file", "shard", "block", "at", "rules", "symbols", "docs", "ids"]
            columns = [pa.array(c) for c in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def write_token_files(
    docs: DataFrame, tokenizer: str, end_id: int = 1, folder: str | None = None, block_ids: int = BLOCK_IDS
) -> DataFrame:
    """Write the files and return the manifest, one row per block.

    Null text counts as empty: such a document is the end id alone.  Documents without an id
    come first; repeated ids are neighbours.  An empty table writes no file.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "token_files")
    system, place = _open(folder)
    system.create_dir(place, recursive=True)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt = rows.repartitionByRange(shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id")
    return written(dealt.mapInArrow(_write(folder, tokenizer, end_id, block_ids), MANIFEST), "manifest")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            system, place = _open(row["file"])
            sizes = (row["rules"], row["symbols"], row["docs"])
            with system.open_input_file(place) as f:
                block = Block(f.read_at(Block.size(*sizes), row["at"]), *sizes)
            ids = block.all_ids()
            parts = [ids[a:b].tobytes() for a, b in zip(block.starts[:-1], block.starts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(block.doc_ids, mask=~block.has_id), pa.array(row["first"] + block.starts[:-1]),
                    pa.array(np.diff(block.starts)), pa.array(parts, pa.binary()),
                ],
                names=["doc_id", "start", "n_tokens", "ids"],
            )


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (binary,
    unsigned 32-bit little-endian), decoded from the files."""
    spark = manifest.sparkSession
    placed = prefix_sum(manifest, [], "shard", ["block"], "ids", "first")
    dealt = placed.select("file", "shard", "block", "at", "rules", "symbols", "docs", F.col("first").cast("long"))
    dealt = dealt.repartition(shuffle_partitions(spark), "shard", "block")
    return dealt.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids binary")
