"""Exact top-k search by inner product as a Voronoi join.

Pivots cut the rows into cells; queries and data are grouped by them, and cells are dealt into
units of bounded size.  First every query meets the rows of the one unit that it lies in itself, which
gives a score that its k-th result reaches at least.  Each cell's summary (pivot, radius, longest
vector) bounds what it can hold for a query q,

    q.x <= q.pivot + |q| * radius     and     q.x <= |q| * longest,

so a query is sent only to the units of cells whose bound reaches its k-th score so far.  There, a
product of matrices and a cut at that score leave few rows for the final ranking.  Data rows move
once a pass and queries, a hundredth of them, as often as bounds make necessary.

Pivots decide only how much is compared, never what is found.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.common import written
from marquee.llm.vector_codes import scaled_floor, usable

SAMPLE = 4096  # rows that pivots are chosen from, by hash
MOST_PIVOTS = 1024
UNIT = 16384  # rows of a unit; with 64 dimensions it takes 8 MB
QUERIES = 4096  # queries that one task holds against a unit
OTHER_CELLS = 64  # cells, without pivot, for vectors of other widths than the pivots'
LOWEST, HIGHEST = -(2**63), 2**63 - 1


def choose_pivots(rows: DataFrame, count: int, wanted: int | None, scale: int) -> np.ndarray:
    """Pivots from a sample by hash: ``wanted`` of them, or as many as an eighth of the square root of the row
    count, 8 at least and ``MOST_PIVOTS`` at most.  Copies are taken once."""
    sample = rows.orderBy(F.xxhash64("row"), "row").select("vector").limit(SAMPLE).collect()
    widths = [len(r.vector) for r in sample]
    width = max(set(widths), key=lambda w: (widths.count(w), w), default=0)
    found = list(dict.fromkeys(tuple(r.vector) for r in sample if len(r.vector) == width))
    wanted = wanted or min(MOST_PIVOTS, max(8, math.isqrt(count) // 8))
    return np.array(found[:wanted], np.float64).reshape(min(wanted, len(found)), width) * scale


def _as_float(whole: np.ndarray) -> np.ndarray:
    return whole.astype(np.float64)


def _matrix(column: pa.Array, scale: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """width -> (places in the column, integer vectors), by width: one, as a rule."""
    ends = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    whole = scaled_floor(column.flatten().to_numpy(zero_copy_only=False), scale)
    widths = np.diff(ends)
    out = {}
    for width in np.unique(widths).tolist():
        at = np.flatnonzero(widths == width)
        out[width] = at, whole[ends[at][:, None] + np.arange(width)]
    return out


def _cells(pivots: np.ndarray, scale: int):
    """Adds the nearest pivot (``cell``; negative for vectors of another width), the distance to it and the length."""

    def run(batches):
        for batch in batches:
            cell, far, length = (np.zeros(batch.num_rows, kind) for kind in (np.int64, float, float))
            for width, (at, whole) in _matrix(batch.column(batch.schema.get_field_index("vector")), scale).items():
                x = _as_float(whole)
                length[at] = np.sqrt((x * x).sum(axis=1))
                cell[at], far[at] = -1 - width % OTHER_CELLS, np.inf
                if len(pivots) and width == pivots.shape[1]:
                    for a in range(0, len(at), 1024):
                        part = x[a : a + 1024]
                        squares = (pivots * pivots).sum(axis=1) - 2 * part @ pivots.T
                        near = squares.argmin(axis=1)
                        cell[at[a : a + 1024]] = near
                        far[at[a : a + 1024]] = np.sqrt(((part - pivots[near]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell), pa.array(far), pa.array(length)],
                names=[*batch.schema.names, "cell", "far", "length"])

    return run


def scores(queries: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Exact integer inner products; those past 64 bits count as the nearest long."""
    if not queries.size or not data.size:
        return np.zeros((len(queries), len(data)), np.int64)
    most = int(np.abs(queries).max()) * int(np.abs(data).max()) * queries.shape[1]
    if most < 2**53:
        return (_as_float(queries) @ _as_float(data).T).astype(np.int64)
    if most < 2**63:
        return queries.astype(np.int64) @ data.astype(np.int64).T
    exact = queries.astype(object) @ data.astype(object).T
    return np.clip(exact, LOWEST, HIGHEST).astype(np.int64)


RESULT = "row long, query_id long, other long, vec_id long, score long"


def _best(queries: pa.Table, data: pa.Table, k: int, scale: int) -> pa.Table:
    """The ``k`` best rows of one unit for each query, leaving out those below the query's ``reached``."""
    mine, theirs = (_matrix(t["vector"].combine_chunks(), scale) for t in (queries, data))
    q_row, d_row = (t["row"].to_numpy() for t in (queries, data))
    q_id = queries["vec_id"].to_numpy()
    known = data["vec_id"].combine_chunks()
    unknown, d_id = known.is_null().to_numpy(zero_copy_only=False), known.fill_null(0).to_numpy()
    reached = queries["reached"].to_numpy()
    out = [[], [], []]
    for width, (q_at, q) in mine.items():
        if width not in theirs:
            continue
        d_at, d = theirs[width]
        by_id = np.lexsort((d_id[d_at], unknown[d_at]))  # ties go to the smaller vec_id, null last
        d_at, d = d_at[by_id], d[by_id]
        for a in range(0, len(q_at), 64):
            block = scores(q[a : a + 64], d)
            for i, line in zip(q_at[a : a + 64], block, strict=True):
                hits = np.flatnonzero((line >= reached[i]) & (d_row[d_at] != q_row[i]))
                if len(hits) > 4 * k:
                    least = np.partition(line[hits], len(hits) - k)[len(hits) - k]
                    hits = hits[line[hits] >= least]
                hits = hits[np.argsort(-line[hits].astype(object) if LOWEST in line[hits] else -line[hits], kind="stable")][:k]
                out[0].append(np.full(len(hits), i))
                out[1].append(d_at[hits])
                out[2].append(line[hits])
    i, j, s = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)
    return pa.table({
        "row": q_row[i], "query_id": q_id[i], "other": d_row[j],
        "vec_id": pa.array(d_id[j], mask=unknown[j]), "score": s}).cast(
        pa.schema([(n, pa.int64()) for n in ("row", "query_id", "other", "vec_id", "score")]))


def _at_home(every: int, k: int, scale: int):
    """Queries of a unit against the unit's rows."""

    def run(unit: pa.Table) -> pa.Table:
        ids = unit["vec_id"].combine_chunks()
        mine = np.flatnonzero(ids.is_valid().to_numpy(zero_copy_only=False) & (ids.fill_null(0).to_numpy() % every == 0))
        queries = unit.take(pa.array(mine))
        queries = queries.append_column("reached", pa.array(np.full(len(mine), LOWEST)))
        return _best(queries, unit, k, scale)

    return run


def _needed(summary: list, pivots: np.ndarray, scale: int):
    """Sends each query to the units of all cells whose bound reaches its ``reached``, but not to its own unit."""

    def run(batches):
        for batch in batches:
            reached = batch.column(batch.schema.get_field_index("reached")).to_numpy().astype(np.float64)
            cell, own = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("cell", "unit"))
            at, to_cell, to_unit = [], [], []
            for width, (rows, whole) in _matrix(batch.column(batch.schema.get_field_index("vector")), scale).items():
                q = _as_float(whole)
                size = np.sqrt((q * q).sum(axis=1))
                for s in summary:
                    bound, parts = size * s.longest, size * s.longest
                    if s.cell >= 0:
                        if width != pivots.shape[1]:
                            continue
                        bound = np.minimum(bound, q @ pivots[s.cell] + size * s.radius)
                        parts = size * (s.longest + 2 * s.radius)
                    elif s.cell != -1 - width % OTHER_CELLS:
                        continue
                    # Doubles err by far less than this; what has no number is not bounded at all.
                    bound = np.nan_to_num(bound + 1e-9 * parts + 1.0, nan=np.inf, posinf=np.inf)
                    go = rows[(bound >= reached[rows]) | (reached[rows] <= LOWEST)]
                    for unit in range(s.units):
                        there = go[(cell[go] != s.cell) | (own[go] != unit)]
                        at.append(there)
                        to_cell.append(np.full(len(there), s.cell))
                        to_unit.append(np.full(len(there), unit))
            at, to_cell, to_unit = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (at, to_cell, to_unit))
            sent = batch.select(["row", "vec_id", "vector", "reached"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*sent.columns, pa.array(to_cell, pa.int64()), pa.array(to_unit, pa.int64())],
                names=[*sent.schema.names, "cell", "unit"])

    return run


def top_k(
    embeddings: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, pivots: int | None = None, unit: int = UNIT
) -> DataFrame:
    """For each row whose vec_id is divisible by ``every``, its ``k`` best other rows:
    query_id, rank (from 1), vec_id, score.

    A component x counts as floor(``scale`` * x); the score is the integer inner product, exact (past 64 bits
    the nearest long).  Ties go to the smaller vec_id, a null vec_id last.  Null vectors and those with a null or
    non-finite component take no part; vectors of different widths are not compared; empty ones score 0 with one another.
    A query leaves out its own row only: repeated rows are results of one another, and a vec_id that
    stands in several rows is as many queries.  Fewer than ``k`` rows give all.  Other columns
    are ignored; an empty table gives no rows.
    """
    vector = F.col("embedding").cast("array<double>")
    rows = embeddings.filter(usable(vector)).select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    rows = written(rows, "search_rows").select("row", "vec_id", vector.alias("vector"))
    count = rows.count()
    chosen = choose_pivots(rows, count, pivots, scale)
    placed = written(rows.mapInArrow(
        _cells(chosen, scale), "row long, vec_id long, vector array<double>, cell long, far double, length double"), "cells")
    units = F.ceil(F.col("rows") / unit).cast("int")
    # One row a cell: MOST_PIVOTS + OTHER_CELLS at most.
    summary = placed.groupBy("cell").agg(
        F.count("*").alias("rows"), F.max("far").alias("radius"), F.max("length").alias("longest"))
    summary = summary.select("*", units.alias("units")).collect()
    of_cell = F.create_map(*[F.lit(x) for s in summary for x in (s.cell, s.units)]) if summary else F.create_map(F.lit(0), F.lit(1))
    own = F.pmod(F.xxhash64("row"), F.try_element_at(of_cell, F.col("cell"))).cast("long")
    placed = placed.withColumn("unit", own)
    data = placed.select("row", "vec_id", "vector", "cell", "unit")
    home = written(data.groupBy("cell", "unit").applyInArrow(_at_home(every, k, scale), RESULT), "home_results")

    reached = home.groupBy("row").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    reached = reached.select("row", F.when(F.col("n") >= k, F.col("least")).alias("reached"))
    queries = data.filter(F.col("vec_id") % every == 0).join(reached, "row", "left")
    queries = queries.withColumn("reached", F.coalesce("reached", F.lit(LOWEST)))
    sent = queries.mapInArrow(
        _needed(summary, chosen, scale),
        "row long, vec_id long, vector array<double>, reached long, cell long, unit long")
    # A unit's queries in shares of bounded size; the unit's rows go to each share.
    sent = written(sent, "sent_queries")
    shares = sent.groupBy("cell", "unit").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("shares"))
    shares = written(shares, "shares")
    mine = sent.join(shares, ["cell", "unit"]).withColumn("share", F.pmod(F.xxhash64("row"), F.col("shares")))
    mine = mine.drop("shares").select("row", "vec_id", "vector", "reached", "cell", "unit", "share")
    theirs = data.join(shares, ["cell", "unit"]).withColumn(
        "share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares").cast("long") - 1))).drop("shares")
    key = ["cell", "unit", "share"]
    away = mine.groupBy(*key).cogroup(theirs.groupBy(*key)).applyInArrow(
        lambda q, d: _best(q, d, k, scale), RESULT)
    found = home.union(written(away, "away_results"))
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "other")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH kept AS (
  SELECT row_number() OVER () AS r, vec_id, [floor(1024 * x::DOUBLE)::BIGINT for x in embedding] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT q.r, q.vec_id AS query_id, d.vec_id,
         list_sum([q.v[i] * d.v[i] for i in range(1, len(q.v) + 1)])::BIGINT AS score
  FROM kept q JOIN kept d ON q.r <> d.r AND len(q.v) = len(d.v) WHERE q.vec_id % 100 = 0),
ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM scored)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""
