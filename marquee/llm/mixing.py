"""Mixing sources to target weights by a low-discrepancy schedule.

Time runs over van der Corput points: slot ``v`` of ``n`` comes at the bit
reversal of ``v``.  Slots are laid out along the cumulative targets of the sources, so
each source owns an interval of points, as long as its target needs, and its
slots are spread evenly over time.  Each source's documents, in hashed order, form
one stream of words that is read around (twice at most) and cut into blocks of equal
size; the slot of rank ``r`` among its source's slots takes block ``r``.
"""

from __future__ import annotations

import itertools
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from marquee.llm.common import WORD_PATTERN, prefix_sum, shuffle_partitions, written
from marquee.sources.files import scratch_scope

WEIGHTS, BUDGET, CAP = (5, 2, 1), 1.5, 2.0
BLOCK = 64  # words
CHUNK = 4096  # slots made from one row


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights=WEIGHTS, budget: float = BUDGET, cap: float = CAP) -> DataFrame:
    """source, source_rank, source_size, target.

    Weights repeat over the sources in code point order, null last.  All share
    ``budget`` times the total size; a target stops at ``cap`` times its source's size
    and the excess is shared again by weight until none is above.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = [F.col("source").isNull(), "source"]
    parts = sums.repartitionByRange(shuffle_partitions(sums.sparkSession), *order)
    parts = written(parts.select("*", F.spark_partition_id().alias("lane"), F.lit(1).alias("one")), "sources")
    ranked = prefix_sum(parts, [], "lane", order, "one", "source_rank").drop("one")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_rank") % len(weights) + 1).cast("int"))
    weighed = written(ranked.withColumn("weight", weight), "weights")

    # One number is searched for: the level at which weight * level fills the budget.
    total = weighed.agg(F.sum("source_size"), F.sum("weight")).first()
    level = budget * (total[0] or 0) / total[1] if total[1] else 0.0
    while True:
        full = F.col("weight") * level >= cap * F.col("source_size")
        held = weighed.agg(
            F.sum(F.when(full, cap * F.col("source_size"))).alias("capped"),
            F.sum(F.when(~full, F.col("weight"))).alias("free"),
        ).first()
        if not held.free or held.capped is None:
            break
        again = (budget * total[0] - held.capped) / held.free
        if again <= level:
            break
        level = again
    target = F.least(F.col("weight") * level, cap * F.col("source_size"))
    return weighed.select("source", "source_rank", "source_size", target.alias("target"), "lane")


def _slots(targets: DataFrame, block: int) -> DataFrame:
    """source_rank, block (rank among the source's slots), slot (place in time)."""
    quota = targets.withColumn("slots", F.ceil(F.col("quota") / block).cast("long"))
    laid = prefix_sum(quota, [], "lane", ["source_rank"], "slots", "first_slot").filter("slots > 0")
    laid = written(laid.select("source_rank", "slots", "first_slot"), "laid")
    n = targets.agg(F.sum(F.ceil(F.col("quota") / block))).first()[0] or 0
    bits = max(1, int(n - 1).bit_length())
    chunks = laid.select(
        "source_rank", "slots", "first_slot",
        F.explode(F.sequence(F.lit(0), F.expr(f"cast((slots - 1) div {CHUNK} as int)"))).alias("chunk"),
    ).repartition(shuffle_partitions(targets.sparkSession), "source_rank", "chunk")
    at = F.explode(
        F.sequence(F.col("chunk") * CHUNK, F.least((F.col("chunk") + 1).cast("long") * CHUNK, F.col("slots")) - 1)
    )
    points = chunks.withColumn("at", at).select("source_rank", (F.col("first_slot") + F.col("at")).alias("v"))
    reverse = F.conv(F.reverse(F.lpad(F.bin("v"), bits, "0")), 2, 10).cast("long")
    lanes = max(0, bits - 10)
    timed = points.select(
        "source_rank", reverse.alias("slot"), F.shiftright(reverse, lanes).alias("lane"), F.lit(1).alias("one")
    )
    blocks = prefix_sum(timed, ["source_rank"], "lane", ["slot"], "one", "block")
    return written(blocks.select("source_rank", "block", "slot"), "slots")


def mix(sized: DataFrame, targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mix in pieces: slot, source_rank, block, row, pass, first_word, words.

    ``sized``: row, doc_id, source_rank, size.  ``first_word`` counts within the document.
    Targets are met to the nearest word.  The stream order is by hash of doc_id, so
    reruns agree.
    """
    targets = targets.withColumn("quota", F.floor(F.col("target") + 0.5).cast("long"))
    hashed = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = sized.filter("size > 0").withColumn("hash", hashed).withColumn("lane", F.substring("hash", 1, 3))
    stream = prefix_sum(rows, ["source_rank"], "lane", ["hash", "doc_id", "size", "row"], "size", "at")
    stream = stream.join(targets.select("source_rank", "source_size", "quota"), "source_rank")
    passes = stream.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(int(-(-CAP // 1)) - 1))))
    begin = F.col("at") + F.col("pass") * F.col("source_size")
    passes = passes.withColumn("begin", begin).withColumn("end", F.least(begin + F.col("size"), F.col("quota")))
    cut = passes.filter("begin < end").withColumn(
        "block", F.explode(F.expr(f"sequence(begin div {block}, (end - 1) div {block})"))
    )
    low = F.greatest(F.col("begin"), F.col("block") * block)
    high = F.least(F.col("end"), (F.col("block") + 1) * block)
    parts = cut.select(
        "source_rank", "block", "row", "pass", (low - F.col("begin")).alias("first_word"), (high - low).alias("words")
    )
    # Slots are made from a few rows by explode, which Spark's size estimates do
    # not count: without the hint it would broadcast them all.
    return parts.join(_slots(targets, block).hint("merge"), ["source_rank", "block"])


def sized_documents(docs: DataFrame, *more: Column) -> DataFrame:
    """row, doc_id, source, size (and ``more``), written once so that ``row`` is fixed."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), *more,
    )
    return written(rows, "sized")


def _ranked(sized: DataFrame, targets: DataFrame) -> DataFrame:
    by = targets.select(F.col("source").alias("of"), "source_rank", "source_size", "target")
    return sized.join(by, F.col("source").eqNullSafe(F.col("of"))).drop("of")


def mixed_documents(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): doc_id, size,
    source_size, target, taken, first_slot, last_slot, n_slots.

    The slots say when the mix reads the document: the first and last place in time that hold words of
    it, and how many places do, counted anew in every pass.  Whoever reads in the order of ``first_slot`` has the sources
    at their weights in any long stretch.
    Null and empty texts have size 0 and nothing is taken of them, in no slot (null, null, 0); null sources are
    one source, the last.  Repeated rows count each.  Other columns are ignored; an
    empty table gives no rows.
    """
    sized = sized_documents(docs)
    targets = written(source_targets(sized), "targets")
    ranked = _ranked(sized, targets)
    pieces = mix(ranked.select("row", "doc_id", "source_rank", "size"), targets, block)
    taken = pieces.groupBy("row").agg(
        F.sum("words").alias("taken"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"),
        F.count(F.lit(1)).alias("n_slots"),
    )
    return ranked.join(taken, "row", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"),
        "first_slot", "last_slot", F.coalesce("n_slots", F.lit(0)).alias("n_slots"),
    )


@pandas_udf(T.StringType())
def _first_words(texts: pd.Series, words: pd.Series) -> pd.Series:
    def cut(text, n):
        *_, last = itertools.islice(re.finditer(WORD_PATTERN, text), int(n))
        return text[: last.end()]

    return pd.Series([cut(t, n) for t, n in zip(texts, words, strict=True)], dtype=object)


def mixed_corpus(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mix as documents, with the columns of ``docs``: a document appears
    once per pass that takes words of it.  Where a source's target ends within a
    document, that pass has only its first words (and ``n_chars``, if there, their length)."""
    carried = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("carried")
    with scratch_scope(docs.sparkSession, "sized", "taken"):
        sized = sized_documents(docs, carried)
        targets = written(source_targets(sized), "targets")
        ranked = _ranked(sized.select("row", "doc_id", "source", "size"), targets)
        pieces = mix(ranked.select("row", "doc_id", "source_rank", "size"), targets, block)
        passes = pieces.groupBy("row", "pass").agg(F.sum("words").alias("words"))
        taken = passes.groupBy("row").agg(F.collect_list("words").alias("passes"))  # as many as passes
        # Written, so that it is not planned again for either part of the union: the driver holds all stages of a plan at once.
        taken = written(taken, "taken")
    # The texts move once at any size (left alone, Spark sends ``taken`` to them while it is small) and are not sorted.
    rows = sized.select("row", "size", "carried").join(taken.hint("shuffle_hash"), "row")
    rows = rows.withColumn("words", F.explode("passes"))
    whole = rows.filter("words = size").select("carried.*")
    part = rows.filter("words < size").withColumn("cut", _first_words("carried.text", "words"))
    new = {"text": F.col("cut"), "n_chars": F.length("cut").cast("long")}
    part = part.select(
        *[new[c].cast(docs.schema[c].dataType).alias(c) if c in new else F.col(f"carried.`{c}`").alias(c)
          for c in docs.columns]
    )
    return whole.union(part)


ORACLE = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS s FROM sized GROUP BY source),
weighed AS (
  SELECT source, s, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
    WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM sums),
-- The sources that stop are the first ones by size over weight.
filling AS (
  SELECT *, coalesce(sum(2.0 * s) OVER before, 0) AS capped, sum(w) OVER rest AS free,
         (SELECT 1.5 * sum(s) FROM sums) AS total
  FROM weighed
  WINDOW before AS (ORDER BY 2.0 * s / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         rest AS (ORDER BY 2.0 * s / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
level AS (
  SELECT (total - capped) / free AS level FROM filling
  WHERE w * ((total - capped) / free) < 2.0 * s ORDER BY 2.0 * s / w, source LIMIT 1),
targets AS (
  SELECT source, s, least(w * coalesce((SELECT level FROM level), 1e300), 2.0 * s)::DOUBLE AS target FROM weighed),
stream AS (
  SELECT row_number() OVER () AS row, d.source, d.doc_id, d.size, t.s, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS quota,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(CAST(d.doc_id AS VARCHAR)), d.doc_id) - d.size AS begins
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
-- Slots, in time's order: the points of each source's interval by their reversed bits.
counted AS (
  SELECT source, CAST(ceil(floor(target + 0.5) / 64) AS BIGINT) AS slots,
         CAST(coalesce(sum(ceil(floor(target + 0.5) / 64)) OVER (
           ORDER BY source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_point
  FROM targets),
points AS (
  SELECT source, unnest(range(first_point, first_point + slots)) AS v,
         (SELECT greatest(1, length(bin(greatest(0, sum(slots)::BIGINT - 1))))::INTEGER FROM counted) AS bits
  FROM counted),
timed AS (SELECT source, CAST('0b' || reverse(lpad(bin(v), bits, '0')) AS BIGINT) AS slot FROM points),
schedule AS (SELECT source, slot, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS block FROM timed),
passes AS (
  SELECT row, source, greatest(0, least(begins + size, quota) - begins) AS words, begins AS low, least(begins + size, quota) AS high FROM stream
  UNION ALL
  SELECT row, source, greatest(0, least(begins + s + size, quota) - begins - s), begins + s, least(begins + s + size, quota) FROM stream),
spans AS (
  SELECT row, source, words, CAST(low AS BIGINT) // 64 AS first_block, (CAST(high AS BIGINT) - 1) // 64 AS last_block
  FROM passes WHERE words > 0),
placed AS (
  SELECT p.row, sum(p.words) AS taken, min(f.slot) AS first_slot, max(l.slot) AS last_slot,
         sum(p.last_block - p.first_block + 1) AS n_slots
  FROM spans p JOIN schedule f ON f.source IS NOT DISTINCT FROM p.source AND f.block = p.first_block
  JOIN schedule l ON l.source IS NOT DISTINCT FROM p.source AND l.block = p.last_block
  GROUP BY p.row)
SELECT doc_id, CAST(size AS BIGINT) AS size, s AS source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken,
       CAST(first_slot AS BIGINT) AS first_slot, CAST(last_slot AS BIGINT) AS last_slot, CAST(coalesce(n_slots, 0) AS BIGINT) AS n_slots
FROM stream d LEFT JOIN placed p ON d.row = p.row
"""
