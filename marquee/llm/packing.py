"""Packing documents into sequences of fixed capacity by minimum bin slack.

Per bin, a bitset subset-sum over the lengths still available finds the fullest
combination around the longest one left; it is removed and the next bin
begins.  The combination only depends on how many pieces of each length
are left, so it is repeated as long as the counts allow: the plan is made from the
histogram of lengths (at most ``capacity`` rows, whatever the corpus), and the pieces
are dealt to the planned places by their rank within their length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import prefix_sum, written
from marquee.llm.tokens import encoder

CAPACITY, END_ID = 1024, 2
LANES = 256


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination (length -> how many) of the largest sum up to ``room``.
    Bounded subset sum: bit ``s`` of ``reach`` is set when sum ``s`` can be made."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted(counts, reverse=True):
        left, some = min(counts[length], room // length), 1
        while left > 0 and not reach >> room:
            some = min(some, left)
            steps.append((length, some, reach))
            reach |= (reach << (some * length)) & mask
            left, some = left - some, 2 * some
        if reach >> room:
            break
    total, out = reach.bit_length() - 1, {}
    for length, some, before in reversed(steps):
        if not before >> total & 1:
            total -= some * length
            out[length] = out.get(length, 0) + some
    return out


def plan(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(combination, how many bins hold it), in order, until nothing is left."""
    counts, bins = {k: v for k, v in counts.items() if v}, []
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        around = fullest({k: v for k, v in counts.items() if v and k <= capacity - longest}, capacity - longest)
        counts[longest] += 1
        around[longest] = around.get(longest, 0) + 1
        times = min(counts[k] // n for k, n in around.items())
        for k, n in around.items():
            counts[k] -= n * times
        counts = {k: v for k, v in counts.items() if v}
        bins.append((around, times))
    return bins


def places(bins: list[tuple[dict[int, int], int]]) -> list[np.ndarray]:
    """Rank ranges of each length: (length, first rank, first bin, pieces of
    the length in a bin, offset of the first of them), sorted by length and rank."""
    used: dict[int, int] = {}
    rows, first_bin = [], 0
    for combination, times in bins:
        offset = 0
        for length in sorted(combination, reverse=True):
            n, rank = combination[length], used.get(length, 0)
            rows.append((length, rank, first_bin, n, offset))
            used[length] = rank + n * times
            offset += n * length
        first_bin += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return list(table.T)


def _cut(path: str, end_id: int, capacity: int):
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        known = encoder(path)
        lane = 0
        for batch in batches:
            out, size = [], 0
            for doc_id, ids in zip(batch.column(0).to_pylist(), known.encode_all(batch.column(1)), strict=True):
                ids += end
                total = len(ids) // 4
                length, start, piece = total % capacity or capacity, 0, 0
                while start < total:
                    out.append((doc_id, piece, start, length, ids[4 * start : 4 * (start + length)], lane % LANES))
                    start, piece, length, lane = start + length, piece + 1, capacity, lane + 1
                size += len(ids)
                if size > 8 << 20:
                    yield _batch(out)
                    out, size = [], 0
            if out:
                yield _batch(out)
        known.forget()

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32()]
    names = ["doc_id", "piece", "start", "length", "ids", "lane"]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names
    )


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian unsigned 32-bit), lane."""
    schema = "doc_id long, piece int, start long, length long, ids binary, lane int"
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return written(rows.mapInArrow(_cut(tokenizer, end_id, capacity), schema), "pieces")


def _place(table: list[np.ndarray]):
    lengths, ranks, bins, several, offsets = table
    span = int(ranks.max(initial=0)) + 1

    def run(batches):
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            # Ranges are sorted by (length, first rank): the last one at or before.
            low = np.searchsorted(lengths, length, side="left")
            at = np.searchsorted(lengths * span + ranks, length * span + np.minimum(rank, span - 1), side="right") - 1
            at = np.maximum(at, low)
            inside = rank - ranks[at]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i) for i in range(batch.num_columns - 1)),
                    pa.array(bins[at] + inside // several[at]),
                    pa.array(offsets[at] + inside % several[at] * length),
                ],
                names=[*batch.schema.names[:-1], "sequence_id", "offset"],
            )

    return run


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    content: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, the ``content`` columns
    (default ``ids``), sequence_id, offset.

    A document is its ids and ``end_id``; only one longer than ``capacity`` is cut,
    its first piece being the shorter one.  Null text counts as empty (one piece: the end
    id).  Repeated rows are packed each; ties are broken arbitrarily but every
    place is taken once.  Other columns are ignored; an empty table gives no rows.
    ``content`` names expressions of the piece columns to carry instead of the
    ids, such as a digest, which keeps the rows of the shuffle narrow.
    """
    content = {"ids": F.col("ids")} if content is None else content
    cut = pieces(docs, tokenizer, capacity, end_id)
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # <= capacity rows
    table = places(plan(histogram, capacity))
    columns = ["doc_id", "piece", "start", "length"]
    rows = cut.select(*columns, *[c.alias(n) for n, c in content.items()], "lane", F.lit(1).alias("one"))
    ranked = prefix_sum(rows, ["length"], "lane", ["doc_id", "piece", "start"], "one", "rank")
    ranked = ranked.select(*columns, *content, F.col("rank").cast("long"))
    schema = ranked.drop("rank").schema.add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(_place(table), schema)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids: the pieces of every sequence in order of offset."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda done, p: F.concat(done, p["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))
