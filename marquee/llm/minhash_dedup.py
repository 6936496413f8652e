"""Near-duplicate documents by MinHash.

1. Every text becomes its set of word shingles, two digests of that set, and
   the minima of many universal hashes.  Equal sets fold into one class.
2. Banding: classes that agree in all minima of a band share a bucket.
3. Candidates of a bucket are verified, first by signature, then on full sets.
   Each class is first held against the smallest of its bucket, which joins large
   groups with one link per member.  Classes of a bucket that are still in
   different components are then held against each other, in blocks.
4. Components by alternating large-star and small-star.

Nothing is capped: a bucket of any size is cut into blocks of fixed size.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm import shingles as S
from marquee.llm.common import code_points, shuffle_partitions, written
from marquee.llm.components import connected_components
from marquee.sources.files import scratch_scope

BANDS, ROWS = 30, 6  # a pair at 0.85 is missed once in 1.4 million, at 0.8 once in 9,000
SLACK = 6.0  # standard deviations below the threshold at which a signature rejects
BLOCK = 256


def _describe(size: int, hashes: int):
    """(row, doc_id, content) -> row, doc_id, n, k1, k2, signature."""

    def run(batches):
        for batch in batches:
            contents = batch.column(2)
            for a, b in S.slices(contents):
                values, offsets = S.shingle_sets(contents.slice(a, b - a), size)
                k1, k2 = S.set_digests(values, offsets)
                signatures = S.minima(values, offsets, hashes)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a),
                    pa.array(np.diff(offsets)), pa.array(k1), pa.array(k2),
                    pa.array([s.tobytes() for s in signatures], pa.binary()),
                ], names=["row", "doc_id", "n", "k1", "k2", "signature"])

    return run


def describe(docs: DataFrame, size: int, hashes: int, carried) -> tuple[DataFrame, DataFrame]:
    """(row, content, carried) and (row, doc_id, n, k1, k2, signature): the texts are needed to the end,
    the rest only until the groups are known."""
    texts = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
        code_points("text").alias("content"), carried.alias("carried"),
    )
    texts = written(texts, "texts")
    schema = "row long, doc_id long, n long, k1 long, k2 long, signature binary"
    described = texts.select("row", "doc_id", "content").mapInArrow(_describe(size, hashes), schema)
    return texts.drop("doc_id"), written(described, "shingled")


def _agree(threshold: float, hashes: int):
    """Signature verification of (u, v, su, sv); keeps (u, v)."""
    least = threshold - SLACK * (threshold * (1 - threshold) / hashes) ** 0.5

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                su, sv = (
                    np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, hashes) for i in (2, 3)
                )
                keep = (su == sv).mean(axis=1) >= least
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).filter(pa.array(keep)) for i in (0, 1)], names=["u", "v"]
                )

    return run


def _equal_enough(size: int, percent: int):
    """Keeps (u, v) of (u, v, tu, tv) with 100 * shared >= percent * union."""

    def run(batches):
        @functools.lru_cache(maxsize=64)
        def shingle_set(node, content):
            return S.shingle_sets(pa.array([content], pa.binary()), size)[0]

        for batch in batches:
            us, vs = [], []
            for a, b in S.slices(batch.column(2)):
                columns = (c.slice(a, b - a).to_pylist() for c in batch.columns)
                for u, v, tu, tv in zip(*columns, strict=True):
                    if _alike(shingle_set(u, tu), shingle_set(v, tv), percent):
                        us.append(u)
                        vs.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"]
            )

    return run


def _verified(pairs: DataFrame, nodes: DataFrame, size: int, percent: int, hashes: int) -> DataFrame:
    """The pairs (u, v) of ``nodes`` that are links."""
    light = nodes.select("node", "n", "signature")
    u = light.toDF("u", "nu", "su")
    v = light.toDF("v", "nv", "sv")
    near = F.least("nu", "nv") * 100 >= F.greatest("nu", "nv") * percent
    sized = pairs.join(u, "u").join(v, "v").filter(near).select("u", "v", "su", "sv")
    likely = written(sized.mapInArrow(_agree(percent / 100, hashes), "u long, v long"), "likely")
    text = nodes.select("node", "content")
    whole = likely.join(text.toDF("u", "tu"), "u").join(text.toDF("v", "tv"), "v").select("u", "v", "tu", "tv")
    return written(whole.mapInArrow(_equal_enough(size, percent), "u long, v long"), "links")


_BLOCK_PAIR = ["key", "kind", "i", "j"]


def _block_pairs(batches):
    """(table, cuts) of complete block pairs, from rows sorted by block pair."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, table]).combine_chunks() if held is not None else table
        changed = np.zeros(max(0, len(table) - 1), bool)
        for name in _BLOCK_PAIR:
            values = table.column(name).to_numpy()
            changed |= values[1:] != values[:-1]
        cuts = [0, *(np.flatnonzero(changed) + 1).tolist()]
        if len(cuts) > 1:
            yield table.slice(0, cuts[-1]), cuts
        held = table.slice(cuts[-1])
    if held is not None and len(held):
        yield held.combine_chunks(), [0, len(held)]


class _Likely:
    """Likely pairs of rows across components, each in one of its buckets only."""

    def __init__(self, threshold: float, bands: int, hashes: int):
        self.threshold, self.bands, self.hashes = threshold, bands, hashes
        self.least = threshold - SLACK * (threshold * (1 - threshold) / hashes) ** 0.5

    def load(self, table: pa.Table) -> None:
        self.columns = {c: table.column(c).to_numpy() for c in ["kind", "i", "j", "side", "band", "node", "component", "n"]}
        raw = b"".join(table.column("signature").to_pylist())
        self.signatures = np.frombuffer(raw, np.uint32).reshape(-1, self.hashes)

    def pairs(self, a: int, b: int) -> np.ndarray:
        """Row pairs (i, j) of the block pair at rows a to b, most alike first."""
        c = {k: v[a:b] for k, v in self.columns.items()}
        rows = np.arange(b - a)
        x, y = rows[c["side"] == 0], rows[c["side"] == 1]
        if c["kind"][0] == 1 and c["i"][0] == c["j"][0]:
            y = x
        apart = c["component"][x][:, None] != c["component"][y][None, :]
        small = np.minimum(c["n"][x][:, None], c["n"][y][None, :])
        apart &= small >= self.threshold * np.maximum(c["n"][x][:, None], c["n"][y][None, :]) - 1
        if y is x:
            apart &= x[:, None] < y[None, :]
        i, j = np.nonzero(apart)
        found, scores = [np.zeros((0, 2), np.int64)], [np.zeros(0)]
        for at in range(0, len(i), 4096):
            u, v = x[i[at : at + 4096]], y[j[at : at + 4096]]
            same = self.signatures[a + u] == self.signatures[a + v]
            share = same.mean(axis=1)
            likely = share >= self.least
            # The first band in which two rows agree is responsible for them.
            first = same[likely].reshape(-1, self.bands, self.hashes // self.bands).all(axis=2).argmax(axis=1)
            likely[np.flatnonzero(likely)] = first == c["band"][0]
            found.append(np.stack([u[likely], v[likely]], axis=1))
            scores.append(share[likely])
        return a + np.concatenate(found)[np.argsort(-np.concatenate(scores), kind="stable")]


def _with_partner(*likely):
    """The rows that have a likely partner in their block pair."""

    def run(batches):
        one = _Likely(*likely)
        for table, cuts in _block_pairs(batches):
            one.load(table)
            rows = [np.unique(one.pairs(a, b)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield from table.select([*_BLOCK_PAIR, "side", "band", "node", "component"]).take(
                pa.array(np.concatenate(rows))
            ).to_batches()

    return run


def _links_in_blocks(size: int, percent: int, *likely):
    """Links across components, checked on full sets.  A pair is left out only if
    links found before in the same block pair join its components already."""

    def run(batches):
        one = _Likely(*likely)
        for table, cuts in _block_pairs(batches):
            one.load(table)
            contents, nodes = table.column("content"), one.columns["node"]
            links = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                sets, root = {}, {}

                def find(x, root=root):
                    while root.get(x, x) != x:
                        x = root[x]
                    return x

                for i, j in one.pairs(a, b).tolist():
                    left, right = find(one.columns["component"][i]), find(one.columns["component"][j])
                    if left == right:
                        continue
                    for r in (i, j):
                        if r not in sets:
                            sets[r] = S.shingle_sets(contents.slice(r, 1).combine_chunks(), size)[0]
                    if _alike(sets[i], sets[j], percent):
                        root[max(left, right)] = min(left, right)
                        links.append((nodes[i], nodes[j]))
            pairs = np.array(links, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

    return run


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = np.sort(np.concatenate([x, y]))
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(both) - shared)


def _across(entries: DataFrame, nodes: DataFrame, found: DataFrame, size: int, percent: int, bands: int, hashes: int) -> DataFrame:
    """Links (u, v) between classes that share a bucket but not a component.

    The classes of a bucket's largest component are only held against the others
    (kind 0), these also against each other (kind 1), block by block: first by
    signature, and the rows that have a likely partner then on full sets.  No pairs leave a
    task but links.
    """
    label = entries.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    parts = label.groupBy("key", "component").agg(F.count("*").alias("part"))
    mixed = parts.groupBy("key").agg(
        F.max(F.struct("part", "component")).alias("top"), F.sum("part").alias("held"), F.count("*").alias("parts")
    )
    mixed = mixed.filter("parts > 1").select(
        "key", F.col("top.component").alias("main"),
        F.ceil(F.col("top.part") / BLOCK).cast("int").alias("main_blocks"),
        F.ceil((F.col("held") - F.col("top.part")) / BLOCK).cast("int").alias("rest_blocks"),
        (F.col("parts") > 2).alias("several"),
    )
    open_ = written(label.join(written(mixed, "mixed"), "key"), "open")
    spread = F.xxhash64("node")
    main = open_.filter("component = main").withColumn("j", F.pmod(spread, "main_blocks").cast("int"))
    rest = open_.filter("component != main").withColumn("own", F.pmod(spread, "rest_blocks").cast("int"))

    def blocks(count: str):
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    other = rest.filter("several").withColumn("other", blocks("rest_blocks"))
    row = ["band", "node", "component"]
    dealt = (
        main.withColumn("i", blocks("rest_blocks")).selectExpr("key", "0 AS kind", "i", "j", "1 AS side", *row)
        .union(rest.withColumn("j", blocks("main_blocks")).selectExpr("key", "0 AS kind", "own AS i", "j", "0 AS side", *row))
        .union(other.selectExpr(
            "key", "1 AS kind", "least(own, other) AS i", "greatest(own, other) AS j",
            "if(own <= other, 0, 1) AS side", *row))
    )
    likely = (percent / 100, bands, hashes)
    light = _in_blocks(dealt, nodes.select("node", "n", "signature"))
    partnered = written(light.mapInArrow(_with_partner(*likely), dealt.schema), "partnered")
    heavy = _in_blocks(partnered, nodes.select("node", "n", "signature", "content"))
    links = heavy.mapInArrow(_links_in_blocks(size, percent, *likely), "u long, v long")
    return written(links, "across")


def _in_blocks(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``rows`` with what ``nodes`` has, dealt out and sorted by block pair."""
    parts = shuffle_partitions(rows.sparkSession)
    return rows.join(nodes, "node").select(
        *rows.columns, *[c for c in nodes.columns if c != "node"]
    ).repartition(parts, *_BLOCK_PAIR).sortWithinPartitions(*_BLOCK_PAIR)


def near_duplicates(
    docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): row, doc_id, n_shingles,
    component_id (smallest doc_id reachable), kept_row (row that stays).

    Texts link when 100 * shared >= percent * union of their distinct shingles.
    Null, empty and white-space texts have no shingle and link with nothing; a text
    of fewer words than a shingle is one shingle.  Repeated rows share their
    class; the row with the smallest doc_id (null last), then the earliest, stays.  Sets
    are compared by 64-bit hashes of their shingles; classes of equal sets by two
    such digests and the set size.  Other columns are ignored; an empty table gives no rows.
    """
    return _grouped(docs, shingle, percent, bands, rows, F.lit(None).cast("int"))[1]


def _grouped(docs, shingle, percent, bands, rows, carried) -> tuple[DataFrame, DataFrame]:
    with scratch_scope(docs.sparkSession, "texts", "grouped"):
        texts, described = describe(docs, shingle, bands * rows, carried)
        return texts, _groups(texts, described, shingle, percent, bands, rows)


def _groups(texts, described, shingle, percent, bands, rows) -> DataFrame:
    hashes = bands * rows
    same = ["n", "k1", "k2"]
    classes = described.filter("n > 0").groupBy(*same).agg(F.min("row").alias("node"))
    classes = written(classes, "classes")
    signed = described.select(F.col("row").alias("node"), "n", "signature")
    nodes = signed.join(classes.select("node"), "node", "left_semi")

    width = rows * 4
    key = F.transform(
        F.sequence(F.lit(0), F.lit(bands - 1)),
        lambda b: F.xxhash64(b, F.substring(F.col("signature"), b * width + 1, F.lit(width))),
    )
    entries = nodes.select("node", F.posexplode(key).alias("band", "key"))
    buckets = entries.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("held"))
    buckets = written(buckets.filter("held > 1").select("key", "hub"), "buckets")
    entries = written(entries.join(buckets, "key"), "bucketed")
    held = signed.join(entries.select("node").distinct(), "node", "left_semi")
    content = texts.select(F.col("row").alias("node"), "content")
    nodes = written(content.join(held.hint("merge"), "node").select("node", "n", "content", "signature"), "candidates")

    stars = entries.filter("node != hub").select(F.col("hub").alias("u"), F.col("node").alias("v")).distinct()
    links = _verified(stars, nodes, shingle, percent, hashes)
    found = written(connected_components(links), "components")
    across = _across(entries.drop("hub"), nodes, found, shingle, percent, bands, hashes)
    if not across.isEmpty():
        found = written(connected_components(links.union(across)), "components")
    return written(_labelled(described, classes, found), "grouped")


def _labelled(described: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    same = ["n", "k1", "k2"]
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    narrow = described.select("row", "doc_id", *same)
    best = narrow.filter("n > 0").groupBy(*same).agg(F.min(first).alias("best"))
    labels = classes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    labels = labels.select(*same, "component").join(best, same)
    tops = labels.groupBy("component").agg(F.min("best").alias("top"))
    labels = labels.select(*same, "component").join(tops, "component")
    labels = written(labels.select(*same, F.col("top.doc_id").alias("top_id"), F.col("top.row").alias("top_row")), "labels")
    out = narrow.join(labels, same, "left")
    return out.select(
        "row", "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("top_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.coalesce("top_row", "row").alias("kept_row"),
    )


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of every
    component the row with the smallest doc_id, and every text without words."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    carried = F.struct(*others, F.col("text").isNull().alias("__text_was_null"))
    texts, labels = _grouped(docs, shingle, percent, BANDS, ROWS, carried)
    gone = labels.filter("row != kept_row").select("row")
    # The same plan at any size, in which texts are not sorted.
    kept = texts.join(gone.hint("shuffle_hash"), "row", "left_anti")
    text = F.when(~F.col("carried.__text_was_null"), F.col("content").cast("string"))
    return kept.select(
        *[text.alias("text") if c == "text" else F.col(f"carried.`{c}`").alias(c) for c in docs.columns]
    )


ORACLE = """
WITH words AS (
  SELECT doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM words),
classes AS (SELECT min(doc_id) AS node, list_sort(s) AS s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY 2, 3),
each AS (SELECT node, n, unnest(s) AS g FROM classes),
shared AS (
  SELECT a.node AS u, b.node AS v, a.n AS nu, b.n AS nv, count(*) AS k
  FROM each a JOIN each b ON a.g = b.g AND a.node < b.node AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY ALL),
links AS (SELECT u, v FROM shared WHERE 100 * k >= 85 * (nu + nv - k)),
both_ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach AS (
  WITH RECURSIVE r(node, to_) AS (
    SELECT node, node FROM classes UNION SELECT r.node, b.v FROM r JOIN both_ways b ON r.to_ = b.u)
  SELECT node, min(to_) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, len(d.s) AS n_shingles, coalesce(r.component_id, d.doc_id) AS component_id,
       d.doc_id = coalesce(r.component_id, d.doc_id) AS kept
FROM sets d LEFT JOIN classes c ON list_sort(d.s) = c.s LEFT JOIN reach r ON c.node = r.node
"""
