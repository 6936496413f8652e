"""One large delimited text file read by many tasks, line breaks inside quoted values included.

The text source cuts a file anywhere, so a task does not know whether its first line begins a record
or continues a quoted value.  Each line therefore counts as a step from either state, outside or inside quotes, and
steps compose:

1. every input split is folded into its own two steps (one row a split leaves a task);
2. a running composition over a file's splits tells in which state each split begins;
3. every split puts its lines together to records.  Only what crosses a split's border, two fragments
   a split at most, is shuffled and joined; all other records stay in the task that read them.

A quote opens a value only as its first character, ``\\`` escapes inside quotes, and a quote closes
the value; so quotes inside unquoted values change nothing.  This is the dialect of Spark's own reader and writer
(whose reading of text that breaks it, such as doubled quotes, is not followed to the letter).
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _steps(sep: str) -> tuple[F.Column, F.Column]:
    """Whether a line ends inside quotes if it began outside, and if it began inside.
    Possessive patterns: no backtracking, and no recursion on long values."""
    s = re.escape(sep)
    body = r'[^"\\]*+(?:\\.[^"\\]*+)*+'
    rest = rf'[^{s}]*+'
    before = rf'(?:(?:"{body}"{rest}|[^"{s}]{rest}|){s})*+'
    opened = rf'"{body}\\?$'
    from_outside = rf"(?s)^{before}{opened}"
    from_inside = rf'(?s)^{body}(?:\\?$|"{rest}{s}{before}{opened})'
    quoted = F.contains("value", F.lit('"'))
    return (
        quoted & F.regexp_like("value", F.lit(from_outside)),
        ~quoted | F.regexp_like("value", F.lit(from_inside)),
    )


def _runs(batch: pa.RecordBatch):
    """Slices of equal (file, block), in order."""
    file, block = batch.column("file"), batch.column("block").to_numpy()
    codes = file.dictionary_encode().indices.to_numpy()
    cuts = np.flatnonzero((codes[1:] != codes[:-1]) | (block[1:] != block[:-1])) + 1
    ends = [0, *cuts.tolist(), batch.num_rows]
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        if b > a:
            yield file[a].as_py(), int(block[a]), batch.slice(a, b - a)


def _states(out: np.ndarray, inside: np.ndarray, state: bool) -> np.ndarray:
    """State after each line, from ``state`` before the first: the last line that does not
    depend on the state, turned once by each odd line since."""
    fixed, odd = out == inside, out & ~inside
    turns = np.cumsum(odd)
    last = np.maximum.accumulate(np.where(fixed, np.arange(len(out)), -1))
    known = last >= 0
    base = np.where(known, out[last], state)
    return base ^ ((turns - np.where(known, turns[last], 0)) % 2 == 1)


def _fold(batches):
    held = {}
    for batch in batches:
        for file, block, part in _runs(batch):
            out, inside = (part.column(c).to_numpy(zero_copy_only=False) for c in ("out", "inside"))
            before = held.get((file, block), (False, True))
            held[file, block] = tuple(bool(_states(out, inside, s)[-1]) for s in before)
    if held:
        yield pa.RecordBatch.from_arrays(
            [pa.array([f for f, _ in held]), pa.array([b for _, b in held], pa.int64()),
             pa.array([o for o, _ in held.values()]), pa.array([i for _, i in held.values()])],
            names=["file", "block", "out", "inside"])


def _starts(splits: DataFrame) -> DataFrame:
    """The splits that begin inside quotes: the running composition of the steps of those before."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file").orderBy("block")
    odd = (F.col("out") & ~F.col("inside")).cast("int")
    fixed = F.col("out") == F.col("inside")
    turned = splits.withColumn("turns", F.sum(odd).over(upto))
    base = F.coalesce(F.last(F.when(fixed, F.col("out")), ignorenulls=True).over(before), F.lit(False))
    since = F.coalesce(F.last("turns").over(before), F.lit(0)) - F.coalesce(
        F.last(F.when(fixed, F.col("turns")), ignorenulls=True).over(before), F.lit(0))
    return turned.withColumn("state", base != (since % 2 == 1)).filter("state").select("file", "block")


def _records(started: set, line_sep: str):
    """Whole records (``place`` null) and, with their place in the file, the fragments at a split's borders:
    ``opens`` for the one that begins a record."""

    def run(batches):
        split, state, pending, head = None, False, [], False

        def border():  # what is left open at the end of a split
            if split is None or not (pending or head):
                return None
            return (line_sep.join(pending), split[0], 2 * split[1] + (not head), not head)

        for batch in batches:
            records, fragments = [], []
            for file, block, part in _runs(batch):
                if (file, block) != split:
                    if left := border():
                        fragments.append(left)
                    split, state, pending = (file, block), (file, block) in started, []
                    head = state  # the first lines continue a record of an earlier split
                out, inside = (part.column(c).to_numpy(zero_copy_only=False) for c in ("out", "inside"))
                after = _states(out, inside, state)
                begins = np.concatenate([[state], after[:-1]])
                lines = part.column("value")
                single = ~begins & ~after
                if single.all() and not pending:
                    records.append(lines)
                else:
                    joined = []
                    for at in np.flatnonzero(~single).tolist():
                        pending.append(lines[at].as_py())
                        if not after[at]:
                            text, pending = line_sep.join(pending), []
                            if head:
                                fragments.append((text, file, 2 * block, False))
                                head = False
                            else:
                                joined.append(text)
                    records += [lines.filter(pa.array(single)), pa.array(joined, pa.string())]
                state = bool(after[-1])
            yield _batch(records, fragments)
        if left := border():
            yield _batch([], [left])

    return run


def _batch(records: list, fragments: list) -> pa.RecordBatch:
    whole = pa.chunked_array([r for r in records if len(r)], pa.string()).combine_chunks()
    none = len(whole)
    text, file, place, opens = zip(*fragments, strict=True) if fragments else ((), (), (), ())
    return pa.RecordBatch.from_arrays([
        pa.concat_arrays([whole, pa.array(text, pa.string())]),
        pa.concat_arrays([pa.nulls(none, pa.string()), pa.array(file, pa.string())]),
        pa.concat_arrays([pa.nulls(none, pa.int64()), pa.array(place, pa.int64())]),
        pa.concat_arrays([pa.nulls(none, pa.bool_()), pa.array(opens, pa.bool_())]),
    ], names=["record", "file", "place", "opens"])


def read_records(spark: SparkSession, path: str, sep: str = "\t", line_sep: str = "\n") -> DataFrame:
    """The records of delimited text as one column ``record``, line breaks inside quotes kept.

    ``path`` is a file, folder or glob of UTF-8 text; splittable files are read in pieces of
    ``spark.sql.files.maxPartitionBytes``, gzip files by one task each.  Empty records are left out.  A value
    that is still open at the end of its file ends there; it never reaches into another file.

    Splits are folded in a first pass over the text; the list of those that begin inside
    quotes comes to the driver (at most one entry a split, of which Spark's driver keeps a list itself).
    """
    out, inside = _steps(sep)
    lines = spark.read.option("lineSep", line_sep).text(path)
    lines = lines.select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        out.alias("out"), inside.alias("inside"))
    folded = lines.drop("value").mapInArrow(_fold, "file string, block long, out boolean, inside boolean")
    started = {(r.file, r.block) for r in _starts(folded).collect()}
    rows = lines.mapInArrow(_records(started, line_sep), "record string, file string, place long, opens boolean")
    whole = rows.filter("place IS NULL").select("record")
    if started:
        number = F.sum(F.col("opens").cast("int")).over(Window.partitionBy("file").orderBy("place"))
        parts = rows.filter("place IS NOT NULL").withColumn("number", number)
        parts = parts.groupBy("file", "number").agg(F.sort_array(F.collect_list(F.struct("place", "record"))).alias("parts"))
        whole = whole.union(parts.select(F.array_join("parts.record", line_sep).alias("record")))
    else:  # what is open at the end of a file
        whole = rows.select("record")
    return whole.filter("record != ''")


def read_delimited(
    spark: SparkSession, path: str, columns: list[str], sep: str = "\t", line_sep: str = "\n",
    null_value: str = "\x01", partitions: int | None = None,
) -> DataFrame:
    """Headerless delimited text as text columns, equal to Spark's multi-line reader but with as many tasks
    as a file has splits.  A quoted empty value is the empty string, an unquoted one NULL; missing
    columns are NULL, surplus ones are ignored.  ``partitions`` deals the rows out anew."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    options = {"sep": sep, "mode": "PERMISSIVE", "emptyValue": "", "nullValue": null_value}
    records = read_records(spark, path, sep, line_sep)
    records = records.repartition(partitions) if partitions else records
    parsed = records.select(F.from_csv("record", schema, options).alias("r"))
    return parsed.select("r.*")
