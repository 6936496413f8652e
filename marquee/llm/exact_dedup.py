"""Exact de-duplication by Grace hashing.

Every task first folds the equal texts of its own input rows, so a text that
fills a third of the table reaches the shuffle once per task.  The folded
records are dealt out by a hash of the text.  A task that receives more distinct
content than its memory budget partitions the records further, by the next
bits of the hash, into spill files, until each bucket fits one open-addressing
table.  Texts count as equal only when their complete content is equal.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.llm.common import code_points, shuffle_partitions, written

FAN_OUT_BITS = 4  # each level of spilling makes 2**4 buckets
MEMORY_BUDGET = 96 << 20  # bytes of distinct content that one table may hold
ROWS_AT_ONCE = 1024


class ContentTable:
    """Open-addressing table (linear probing) of distinct contents.

    ``rows[i]`` folds all records of one content: ``[hash, content, rank, extra,
    count, groups, members]`` where ``rank`` orders rows by who stays.
    """

    def __init__(self):
        self.slots = [-1] * 1024
        self.rows: list[list] = []
        self.bytes = 0

    def add(self, record: list) -> int:
        """Fold ``record`` in; the number of its content's row."""
        i = self._find(record[0], record[1])
        if self.slots[i] < 0:
            self.slots[i] = len(self.rows)
            self.rows.append(record)
            self.bytes += len(record[1]) + 200
            if 2 * len(self.rows) > len(self.slots):
                self._grow()
            return len(self.rows) - 1
        kept = self.rows[self.slots[i]]
        if record[2] > kept[2]:
            kept[2], kept[3] = record[2], record[3]
        kept[4] += record[4]
        kept[5] += record[5]
        kept[6] += record[6]
        return self.slots[i]

    def _find(self, key: int, content: bytes) -> int:
        mask = len(self.slots) - 1
        i = key & mask
        while self.slots[i] >= 0:
            row = self.rows[self.slots[i]]
            if row[0] == key and row[1] == content:
                break
            i = (i + 1) & mask
        return i

    def _grow(self) -> None:
        self.slots = [-1] * (4 * len(self.slots))
        mask = len(self.slots) - 1
        for n, row in enumerate(self.rows):
            i = row[0] & mask
            while self.slots[i] >= 0:
                i = (i + 1) & mask
            self.slots[i] = n


def _rank(doc_id, row: int) -> tuple:
    """Largest doc_id first, null last; of equal ones the earliest row."""
    return (doc_id is not None, doc_id if doc_id is not None else 0, -row)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(at, ROWS_AT_ONCE)
            yield from zip(*(c.to_pylist() for c in part.columns), strict=True)


def _emit(rows: list[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    size, chunk = 0, []
    for row in rows:
        chunk.append(row)
        size += len(row["content"]) + 64
        if size > 8 << 20:
            yield pa.RecordBatch.from_pylist(chunk, schema=schema)
            size, chunk = 0, []
    if chunk:
        yield pa.RecordBatch.from_pylist(chunk, schema=schema)


def _folded(row: list) -> dict:
    (_, best_id, back), extra = row[2], row[3]
    return {
        "hash": row[0], "content": row[1], "best_id": best_id if row[2][0] else None,
        "best_row": -back, "extra": extra, "n": row[4], "groups": row[5], "members": row[6],
    }


def _fold_task(schema: pa.Schema):
    """Folds the equal texts of one task's rows (hash, content, doc_id, extra)."""

    def run(batches):
        first = TaskContext.get().partitionId() << 33
        table, row, group = ContentTable(), first, first
        for key, content, doc_id, extra in _records(batches):
            added = table.add([key, content, _rank(doc_id, row), extra, 1, [], [(doc_id, row)]])
            if not table.rows[added][5]:
                table.rows[added][5].append(group)
                group += 1
            row += 1
            if table.bytes > MEMORY_BUDGET or row % 500_000 == 0:
                yield from _emit([_folded(r) for r in table.rows], schema)
                table = ContentTable()
        yield from _emit([_folded(r) for r in table.rows], schema)

    return run


def _spill_schema(extra: pa.DataType) -> pa.Schema:
    return pa.schema([
        ("hash", pa.int64()), ("content", pa.large_binary()), ("best_id", pa.int64()), ("best_row", pa.int64()),
        ("extra", extra), ("n", pa.int64()), ("groups", pa.list_(pa.int64())),
    ])


def _grace(records, level: int, folder: str, schema: pa.Schema, budget: int) -> Iterator[list]:
    """Rows of distinct content; recursion by spill files beyond ``budget``."""
    table = ContentTable()
    records = iter(records)
    for key, content, best_id, best_row, extra, n, groups in records:
        table.add([key, content, _rank(best_id, best_row), extra, n, list(groups), []])
        if table.bytes > budget and len(table.rows) > 1:
            break
    else:
        yield from table.rows
        return
    paths = [os.path.join(folder, f"{level}-{i}") for i in range(1 << FAN_OUT_BITS)]
    waiting: list[list[dict]] = [[] for _ in paths]
    sizes = [0] * len(paths)
    with _writers(paths, schema) as files:

        def put(record: dict) -> None:
            i = (record["hash"] >> (60 - FAN_OUT_BITS * level)) & ((1 << FAN_OUT_BITS) - 1)
            waiting[i].append(record)
            sizes[i] += len(record["content"])
            if sizes[i] > 2 << 20:
                flush(i)

        def flush(i: int) -> None:
            files[i].write_batch(pa.RecordBatch.from_pylist(waiting[i], schema=schema))
            waiting[i], sizes[i] = [], 0

        for row in table.rows:
            folded = _folded(row)
            del folded["members"]
            put(folded)
        del table
        for record in records:
            put(dict(zip(schema.names, record, strict=True)))
        for i in range(len(paths)):
            if waiting[i]:
                flush(i)
    # Hashes have 64 bits: below the last level one table takes what is left.
    deeper = budget if FAN_OUT_BITS * (level + 1) < 60 else float("inf")
    for path in paths:
        with pa.ipc.open_file(path) as spilled:
            batches = (spilled.get_batch(i) for i in range(spilled.num_record_batches))
            inner = os.path.join(folder, f"{os.path.basename(path)}-in")
            os.mkdir(inner)
            yield from _grace(_records(batches), level + 1, inner, schema, deeper)
        os.remove(path)


class _writers:
    def __init__(self, paths, schema):
        self.files = [pa.ipc.new_file(p, schema) for p in paths]

    def __enter__(self):
        return self.files

    def __exit__(self, *_):
        for f in self.files:
            f.close()


def _grace_task(schema: pa.Schema, extra: pa.DataType, with_rows: bool, budget: int):
    def run(batches):
        # Spill files live only as long as the task; a retried task makes its own.
        with tempfile.TemporaryDirectory(prefix="grace-") as folder:
            out = []
            for row in _grace(_records(batches), 0, folder, _spill_schema(extra), budget):
                done = _folded(row)
                out.append(
                    {"content": done["content"], "extra": done["extra"]} if with_rows else {
                        "keep_id": done["best_id"], "keep_row": done["best_row"], "group_size": done["n"],
                        "text_sha256": hashlib.sha256(done["content"]).hexdigest(), "groups": done["groups"],
                    })
                if len(out) >= 256:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _folded_schema(extra: T.DataType) -> T.StructType:
    ids = T.ArrayType(T.LongType())
    member = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("row", T.LongType())])
    return T.StructType([
        T.StructField("hash", T.LongType()), T.StructField("content", T.BinaryType()),
        T.StructField("best_id", T.LongType()), T.StructField("best_row", T.LongType()),
        T.StructField("extra", extra), T.StructField("n", T.LongType()),
        T.StructField("groups", ids), T.StructField("members", T.ArrayType(member)),
    ])


def _fold(docs: DataFrame, extra) -> DataFrame:
    content = code_points("text")
    rows = docs.select(
        F.xxhash64(content).alias("hash"), content.alias("content"),
        F.col("doc_id").cast("long").alias("doc_id"), extra.alias("extra"),
    )
    schema = _folded_schema(rows.schema["extra"].dataType)
    return rows.mapInArrow(_fold_task(_arrow(schema)), schema)


def _deal(folded: DataFrame, out: T.StructType, with_rows: bool, budget: int) -> DataFrame:
    extra = _arrow(T.StructType([folded.schema["extra"]])).field(0).type
    dealt = folded.drop("members").repartition(shuffle_partitions(folded.sparkSession), "hash")
    return dealt.mapInArrow(_grace_task(_arrow(out), extra, with_rows, budget), out)


def exact_duplicates(docs: DataFrame, memory_budget: int = MEMORY_BUDGET) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size,
    kept, text_sha256.

    Null text counts as empty; all empty texts are one group.  Of equal texts
    the row with the largest doc_id stays (null doc_ids lose; of rows that
    share the largest doc_id exactly one is kept).  Other columns are ignored; an
    empty table gives no rows.
    """
    folded = written(_fold(docs, F.lit(None).cast("int")), "folded")
    out = T.StructType([
        T.StructField("keep_id", T.LongType()), T.StructField("keep_row", T.LongType()),
        T.StructField("group_size", T.LongType()), T.StructField("text_sha256", T.StringType()),
        T.StructField("groups", T.ArrayType(T.LongType())),
    ])
    decided = _deal(folded, out, False, memory_budget).withColumn("group", F.explode("groups")).drop("groups")
    members = folded.select(F.element_at("groups", 1).alias("group"), "members")
    joined = members.join(decided, "group")
    each = joined.select(F.explode("members").alias("m"), "keep_id", "keep_row", "group_size", "text_sha256")
    return each.select(
        F.col("m.doc_id").alias("doc_id"), "keep_id", "group_size",
        (F.col("m.row") == F.col("keep_row")).alias("kept"), "text_sha256",
    )


def drop_exact_duplicates(docs: DataFrame, memory_budget: int = MEMORY_BUDGET) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns (see above)."""
    others = [c for c in docs.columns if c != "text"]
    extra = F.struct(*[F.col(f"`{c}`") for c in others], F.col("text").isNull().alias("__text_was_null"))
    folded = _fold(docs, extra)
    out = T.StructType([T.StructField("content", T.BinaryType()), folded.schema["extra"]])
    kept = _deal(folded, out, True, memory_budget)
    text = F.when(~F.col("extra.__text_was_null"), F.col("content").cast("string"))
    return kept.select(
        *[text.alias("text") if c == "text" else F.col(f"extra.`{c}`").alias(c) for c in docs.columns]
    )


ORACLE = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
