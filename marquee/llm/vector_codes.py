"""Vectors as short codes: one codebook a part, built over per-dimension value dictionaries.

Components are integers, and a dimension takes few different ones.  So vectors are kept in blocks as
dictionary codes: per dimension the distinct integers of the block and each vector's place among them.
Against a codebook, the squared difference of every distinct integer to every entry is tabulated
once a block and dimension; a part's distances are then rows gathered from its tables and added.  The sums
that move an entry come from counts of (entry, dictionary code) pairs, again without the vectors.

All arithmetic is on integers: 32 or 64 bits wide where the block's largest value allows it, Python's own beyond.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import label_totals, written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
BLOCK = 8192  # vectors of a block: its tables and distances take about 10 MB
LIMB = 40  # sums leave a task in digits of so many bits, which Spark adds as longs
LONGEST = 2**63 - 1


def scaled_floor(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of finite doubles, exact: int64 where it fits, Python integers beyond."""
    values = values.astype(np.float64)
    if not len(values) or np.abs(values).max() < 2**62 / scale:
        return np.floor(values * scale).astype(np.int64)
    # From 2^53 on a double is an integer by itself.
    whole = [int(x) * scale if abs(x) >= 2**53 else math.floor(x * scale) for x in values.tolist()]
    return np.array(whole, object)


def usable(vector) -> F.Column:
    """Not null, and no component null, NaN or infinite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & finite


def part_bounds(width: int, parts: int) -> list[int]:
    """Where parts begin and end; the first ones are longer by one where ``width`` is no multiple."""
    return [width * i // parts if width % parts == 0 else min(i, width % parts) + width // parts * i for i in range(parts + 1)]


ENCODED = "ids array<long>, labels array<{label}>, sizes array<int>, values array<string>, codes binary"


def _encode(width: int, scale: int):
    """Blocks of vectors as dictionary codes: per dimension the distinct integers
    (``values`` as decimal text, ``sizes`` many of each dimension), and ``codes``, dimension by dimension."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                flat = part.column(2).flatten().to_numpy(zero_copy_only=False)
                whole = scaled_floor(flat, scale).reshape(-1, width)
                values, codes = [], []
                for d in range(width):
                    distinct, code = np.unique(whole[:, d], return_inverse=True)
                    values.append([str(x) for x in distinct.tolist()])
                    codes.append(code.astype("<u2"))
                yield pa.RecordBatch.from_arrays([
                    pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())),
                    pa.array([part.column(1).to_pylist()], pa.list_(part.column(1).type)),
                    pa.array([[len(v) for v in values]], pa.list_(pa.int32())),
                    pa.array([[x for v in values for x in v]], pa.list_(pa.string())),
                    pa.array([np.concatenate(codes).tobytes()] if codes else [b""], pa.binary()),
                ], names=["ids", "labels", "sizes", "values", "codes"])

    return run


class Codebook:
    """``entries[p]`` is an (entries, part width) table of integers."""

    def __init__(self, entries: list[np.ndarray]):
        self.entries = entries
        self.bounds = np.cumsum([0, *(e.shape[1] for e in entries)]).tolist()

    def sha256(self) -> str:
        flat = ",".join(str(x) for part in self.entries for x in part.reshape(-1).tolist())
        return hashlib.sha256(flat.encode()).hexdigest()


class Block:
    """One block of dictionary-coded vectors."""

    def __init__(self, row: dict, width: int):
        self.size = len(row["ids"])
        flat = [int(x) for x in row["values"]]
        self.largest = max(map(abs, flat), default=0)
        ends = np.cumsum([0, *row["sizes"]])
        self.values = [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        self.codes = np.frombuffer(row["codes"], "<u2").reshape(width, self.size).astype(np.intp)

    def nearest(self, book: Codebook, p: int) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry of part ``p`` for each vector (ties: the lower index) and its squared distance."""
        entries, low = book.entries[p], book.bounds[p]
        largest = max(self.largest, max((abs(x) for x in entries.reshape(-1).tolist()), default=0))
        worst = (2 * largest) ** 2 * max(entries.shape[1], 1)
        kind = np.int32 if worst < 2**31 else np.int64 if worst < 2**63 else object
        total = np.zeros((self.size, len(entries)), kind)
        for j in range(entries.shape[1]):
            values = np.array(self.values[low + j], object if kind is object else np.int64)
            table = ((values[:, None] - entries[None, :, j].astype(values.dtype)) ** 2).astype(kind)
            total += table[self.codes[low + j]]
        best = total.argmin(axis=1) if kind is not object else np.array([r.tolist().index(min(r)) for r in total], np.intp)
        return best, total[np.arange(self.size), best]


def _blocks(batches, width):
    for batch in batches:
        for row in batch.to_pylist():
            yield Block(row, width), row


def _assigned_sums(book: Codebook, width: int):
    """Per part, entry and dimension the sum of the vectors assigned to it and their
    number, as far as this task goes; sums as digits (``limb``) of ``LIMB`` bits."""

    def run(batches):
        sums, counts = {}, {}
        for block, _ in _blocks(batches, width):
            for p, entries in enumerate(book.entries):
                best, _ = block.nearest(book, p)
                held = np.bincount(best, minlength=len(entries))
                for e in np.flatnonzero(held).tolist():
                    counts[p, e] = counts.get((p, e), 0) + int(held[e])
                for j in range(entries.shape[1]):
                    values = block.values[book.bounds[p] + j]
                    pairs = best * len(values) + block.codes[book.bounds[p] + j]
                    times = np.bincount(pairs, minlength=len(entries) * len(values)).reshape(len(entries), -1)
                    small = block.largest < 2**40
                    moved = times @ np.array(values, np.int64) if small else times.astype(object) @ np.array(values, object)
                    for e in np.flatnonzero(held).tolist():
                        sums[p, e, j] = sums.get((p, e, j), 0) + int(moved[e])
        rows = [(p, e, -1, 0, n) for (p, e), n in counts.items()]
        for (p, e, j), total in sums.items():
            sign, total, limb = (1, -1)[total < 0], abs(total), 0
            while total:
                rows.append((p, e, j, limb, sign * (total & (2**LIMB - 1))))
                total, limb = total >> LIMB, limb + 1
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(x), pa.int64()) for x in zip(*rows, strict=True)], names=["part", "entry", "at", "limb", "total"])

    return run


def _moved(encoded: DataFrame, book: Codebook, width: int) -> Codebook:
    """Every used entry becomes the floor of its vectors' mean.  What comes back to the
    driver has the codebook's size, whatever the number of vectors."""
    rows = encoded.mapInArrow(_assigned_sums(book, width), "part long, entry long, at long, limb long, total long")
    sums, counts = {}, {}
    for row in rows.groupBy("part", "entry", "at", "limb").agg(F.sum("total").alias("total")).collect():
        if row["at"] < 0:
            counts[row.part, row.entry] = row.total
        else:
            key = row.part, row.entry, row["at"]
            sums[key] = sums.get(key, 0) + (row.total << (LIMB * row.limb))
    entries = [e.astype(object) for e in book.entries]
    for (p, e), n in counts.items():
        for j in range(entries[p].shape[1]):
            entries[p][e, j] = sums.get((p, e, j), 0) // n
    return Codebook([_narrow(e) for e in entries])


def _narrow(entries: np.ndarray) -> np.ndarray:
    fits = all(abs(x) < 2**62 for x in entries.reshape(-1).tolist())
    return entries.astype(np.int64) if fits else entries.astype(object)


def _assigned(book: Codebook, width: int, label: pa.DataType):
    def run(batches):
        for block, row in _blocks(batches, width):
            digits, error = [], np.zeros(block.size, np.int64 if block.largest < 2**20 else object)
            for p in range(len(book.entries)):
                best, distance = block.nearest(book, p)
                digits.append(best.astype(np.uint8))
                error = error + distance
            codes = np.stack(digits, axis=1).tobytes().hex()
            step = 2 * len(book.entries)
            yield pa.RecordBatch.from_arrays([
                pa.array(row["ids"], pa.int64()), pa.array(row["labels"], label),
                pa.array([codes[i * step : (i + 1) * step] for i in range(block.size)]),
                pa.array([min(int(x), LONGEST) for x in error.tolist()], pa.int64()),
            ], names=["vec_id", "label", "code", "error"])

    return run


def vector_codes(
    embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> DataFrame:
    """One row per row of ``embeddings`` (vec_id, embedding, label) whose vector is usable:
    vec_id, label, code, error, label_error, codebooks_sha256.

    A component x counts as floor(``scale`` * x).  Each of the ``parts`` has a codebook that starts as that part of the
    vectors with the ``entries`` (256 at most) smallest vec_ids (null last; ties by the vector) and moves
    ``rounds`` times to the floors of its vectors' means.  ``code`` has two hex digits a part; ``error`` is the squared
    distance to what the code stands for, ``label_error`` its sum over equal labels, nulls together.

    Null vectors and those with a null or non-finite component are dropped.  The width most vectors have
    (ties: the larger) is the codebooks'; vectors of any other width, empty ones too, keep their row with null code
    and error.  Repeated rows count each.  Where a width is no multiple of ``parts``, the first parts are longer by one.
    Errors past 64 bits are given as the largest long.  Other columns are ignored; an empty table gives no rows.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries must be between 1 and 256: a code has two hex digits a part")
    spark = embeddings.sparkSession
    vector = F.col("embedding").cast("array<double>")
    rows = embeddings.filter(usable(vector)).select(F.col("vec_id").cast("long").alias("vec_id"), "label", vector.alias("vector"))
    common = rows.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    width = common.width if common else 0
    fit, kind = rows.filter(F.size("vector") == width), rows.schema["label"].dataType
    encoded = written(fit.mapInArrow(_encode(width, scale), ENCODED.format(label=kind.simpleString())), "coded_vectors")
    first = fit.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).collect()
    start = [scaled_floor(np.array(r.vector, np.float64), scale).tolist() for r in first]
    start = np.array(start, object).reshape(len(start), width)
    bounds = part_bounds(width, parts)
    book = Codebook([_narrow(start[:, a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
    for _ in range(rounds):
        book = _moved(encoded, book, width)
    found = f"vec_id long, label {kind.simpleString()}, code string, error long"
    label = pa.schema(spark.createDataFrame([], f"label {kind.simpleString()}").toArrow().schema).field(0).type
    coded = encoded.mapInArrow(_assigned(book, width, label), found)
    others = rows.filter(F.size("vector") != width).selectExpr("vec_id", "label", "CAST(NULL AS STRING) AS code", "CAST(NULL AS BIGINT) AS error")
    coded = written(coded.union(others), "codes")
    return label_totals(coded, "label", "error", "label_error").withColumn("codebooks_sha256", F.lit(book.sha256()))


ORACLE = """
WITH kept AS (
  SELECT vec_id, label, [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
places AS (
  SELECT vec_id, label, p, list_slice(v, p * (len(v) // 16) + 1, (p + 1) * (len(v) // 16)) AS part
  FROM kept, (SELECT unnest(range(0, 16)) AS p) parts),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept QUALIFY entry < 64),
{books}
final AS (
  SELECT vec_id, label, p, entry, distance FROM (
    SELECT s.vec_id, s.label, s.p, b.entry, {distance} AS distance,
           row_number() OVER (PARTITION BY s.vec_id, s.p ORDER BY {distance}, b.entry) AS nth
    FROM places s JOIN book{rounds} b ON b.p = s.p) near WHERE nth = 1),
coded AS (
  SELECT vec_id, label, string_agg(lpad(to_hex(entry), 2, '0'), '' ORDER BY p) AS code, sum(distance)::BIGINT AS error
  FROM final GROUP BY vec_id, label),
books AS (SELECT sha256(string_agg(array_to_string(part, ','), ',' ORDER BY p, entry)) AS codebooks_sha256 FROM book{rounds})
SELECT vec_id, label, lower(code) AS code, error,
       (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM coded, books
"""
_DISTANCE = "list_sum([(s.part[i] - b.part[i]) * (s.part[i] - b.part[i]) for i in range(1, len(s.part) + 1)])"
_ROUND = """near{n} AS (
  SELECT p, entry, part FROM (
    SELECT s.p, s.part, b.entry, row_number() OVER (PARTITION BY s.vec_id, s.p ORDER BY {distance}, b.entry) AS nth
    FROM places s JOIN book{n} b ON b.p = s.p) near WHERE nth = 1),
means{n} AS (
  SELECT p, entry, list(mean ORDER BY i) AS part FROM (
    SELECT p, entry, i, floor(sum(part[i])::DOUBLE / count(*))::BIGINT AS mean
    FROM (SELECT p, entry, part, unnest(range(1, len(part) + 1)) AS i FROM near{n}) listed GROUP BY p, entry, i) sums
  GROUP BY p, entry),
book{m} AS MATERIALIZED (
  SELECT b.p, b.entry, coalesce(m.part, b.part) AS part
  FROM book{n} b LEFT JOIN means{n} m ON m.p = b.p AND m.entry = b.entry),"""
ORACLE = ORACLE.format(
    books="book0 AS MATERIALIZED (SELECT s.p, f.entry, s.part FROM places s JOIN first f ON f.vec_id = s.vec_id),\n"
    + "\n".join(_ROUND.format(n=n, m=n + 1, distance=_DISTANCE) for n in range(ROUNDS)),
    distance=_DISTANCE, rounds=ROUNDS,
)
