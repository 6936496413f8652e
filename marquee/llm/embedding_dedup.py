"""Near-duplicate vectors by a pivot-permutation index.

Vectors of a bounded sample that are far from one another serve as pivots.  Every vector is described by the
ordered list of its nearest pivots; inverted lists hold, per label and pair of
pivots, the vectors that have both in their list, so vectors meet when they share
at least two pivots.  Shared-pivot counts tell which of their common lists is
responsible for a pair, so each pair is verified and counted once.  Lists of any
length are cut into blocks of bounded size that are compared pair by pair of blocks; a block
sends on counts and a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.llm.common import written
from marquee.llm.components import connected_components

PIVOTS, NEAREST = 48, 5
SAMPLE, APART = 4096, 0.7  # vectors that pivots are chosen from; pivots' cosines are below
BLOCK = 512


def _usable(vector) -> F.Column:
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    )
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def choose_pivots(classes: DataFrame, pivots: int = PIVOTS, nearest: int = NEAREST) -> np.ndarray:
    """Up to ``pivots`` unit vectors that are far from one another.

    From a sample of classes by hash of their ids (``SAMPLE`` at most), the vector that is
    farthest from all pivots so far is taken next, and none with a cosine of ``APART`` or more to one;
    so a family of near copies has one pivot, whatever its share of the rows.  No more
    pivots than a list holds would put all vectors into every list: then two are enough.
    """
    rows = classes.select("vector", F.xxhash64("node").alias("h"), "node").orderBy("h", "node").limit(SAMPLE).collect()
    widths = pd.Series([len(r.vector) for r in rows]).mode()
    vectors = np.array([r.vector for r in rows if len(r.vector) == widths[0]], float) if rows else np.zeros((0, 0))
    chosen = farthest_first(_unit(vectors), pivots)
    return chosen if len(chosen) > nearest else chosen[:2]


def farthest_first(vectors: np.ndarray, pivots: int) -> np.ndarray:
    if not len(vectors):
        return vectors
    chosen, closest = [0], vectors @ vectors[0]
    while len(chosen) < pivots and closest.min() < APART:
        chosen.append(int(closest.argmin()))
        closest = np.maximum(closest, vectors @ vectors[chosen[-1]])
    return vectors[chosen]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True, initial=0), 1e-300)
    return x / np.linalg.norm(x, axis=1, keepdims=True) if len(x) else x


def _nearest(pivots: np.ndarray, nearest: int):
    """Adds the list of the nearest pivots, in pivot order.  Vectors of another width
    than the pivots' all get the list of the first two."""

    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("vector"))
            vectors = column.to_numpy(zero_copy_only=False)
            lists = [[0, 1]] * len(vectors)
            fit = [i for i, v in enumerate(vectors) if len(v) == pivots.shape[1]]
            if fit:
                cosines = _unit(np.stack([vectors[i] for i in fit])) @ pivots.T
                near = np.argsort(-cosines, axis=1, kind="stable")[:, :nearest]
                for i, row in zip(fit, np.sort(near, axis=1), strict=True):
                    lists[i] = row.tolist() if len(row) > 1 else [0, 1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(lists, pa.list_(pa.int32()))], names=[*batch.schema.names, "near"]
            )

    return run


def _links(classes: DataFrame, pivots: np.ndarray, threshold: float, nearest: int) -> DataFrame:
    """node, links, root from every block of every inverted list."""
    columns = classes.select("node", "label", "held", "vector")
    schema = T.StructType([*columns.schema.fields, T.StructField("near", T.ArrayType(T.IntegerType()))])
    indexed = written(columns.mapInArrow(_nearest(pivots, nearest), schema), "index")
    pair = F.flatten(
        F.transform("near", lambda x: F.transform(
            F.filter("near", lambda y: y > x), lambda y: F.struct(x.alias("one"), y.alias("other"))))
    )
    entries = indexed.select("node", "label", F.explode(pair).alias("list")).select("node", "label", "list.*")
    key = ["label", "one", "other"]
    lists = written(entries.groupBy(*key).agg(F.count("*").alias("length")).filter("length > 1"), "lists")
    blocks = F.ceil(F.col("length") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    dealt = entries.join(lists, key).withColumn("own", own)
    dealt = dealt.withColumn("across", F.explode(F.sequence(F.lit(0), blocks - 1)))
    left = dealt.filter("own <= across").selectExpr("node", *key, "own AS i", "across AS j", "0 AS side")
    right = dealt.filter("own >= across").selectExpr("node", *key, "across AS i", "own AS j", "1 AS side")
    sides = left.union(right).join(indexed.select("node", "held", "vector", "near"), "node")
    return written(
        sides.groupBy(*key, "i", "j").applyInPandas(
            _verify(threshold, max(2, len(pivots))), "node long, links long, root long"),
        "vector_links",
    )


def _forest(links: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each row of a symmetric boolean matrix."""
    root = np.arange(len(links))
    while True:
        least = np.where(links, root[None, :], len(links)).min(axis=1, initial=len(links))
        new = np.minimum(root, least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _verify(threshold: float, pivots: int):
    """Links of one block pair of an inverted list: per class, how many vectors
    it gained here (``links``) and the smallest class it is joined to (``root``)."""

    def member(part):
        m = np.zeros((len(part), pivots), np.float32)
        for r, near in enumerate(part["near"]):
            m[r, near] = 1
        return m

    def run(block: pd.DataFrame) -> pd.DataFrame:
        one, other = int(block["one"].iloc[0]), int(block["other"].iloc[0])
        left, right = block[block["side"] == 0], block[block["side"] == 1]
        widths = block["vector"].map(len)
        parts = []
        for width in widths.unique():  # one, as a rule
            parts.append(compare(left[widths[left.index] == width], right[widths[right.index] == width], one, other))
        return pd.concat(parts).astype("int64")

    def compare(left, right, one, other) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"node": [], "links": [], "root": []})
        a, b = _unit(np.stack(left["vector"])), _unit(np.stack(right["vector"]))
        links = a @ b.T >= threshold
        ma, mb = member(left), member(right)
        # The list of the two smallest shared pivots is responsible for a pair.
        links &= ma[:, :other] @ mb[:, :other].T == 1
        na, nb = left["node"].to_numpy(), right["node"].to_numpy()
        if left["i"].iloc[0] == left["j"].iloc[0]:
            links &= na[:, None] < nb[None, :]
        counts = pd.concat([
            pd.DataFrame({"node": na, "links": links @ right["held"].to_numpy()}),
            pd.DataFrame({"node": nb, "links": links.T @ left["held"].to_numpy()}),
        ]).groupby("node", as_index=False)["links"].sum()
        nodes = np.unique(np.concatenate([na, nb]))
        at, bt = np.searchsorted(nodes, na), np.searchsorted(nodes, nb)
        square = np.zeros((len(nodes), len(nodes)), bool)
        x, y = np.nonzero(links)
        square[at[x], bt[y]] = True
        square |= square.T
        counts["root"] = nodes[_forest(square)][np.searchsorted(nodes, counts["node"])]
        return counts[counts["links"] > 0]

    return run


def near_vectors(
    embeddings: DataFrame, threshold: float = 0.93, pivots: int = PIVOTS, nearest: int = NEAREST
) -> DataFrame:
    """One row per row of ``embeddings`` (vec_id, embedding, label): vec_id,
    n_links, component_id, kept.

    Vectors of the same non-null label link when their cosine, in double precision, is
    ``threshold`` or more.  Null or empty vectors, zero ones, and those with a null or
    non-finite component link with nothing, nor do vectors of different widths.  Equal vectors
    of a label (also repeated rows) are indexed once and count as linked among themselves.
    Other columns are ignored; an empty table gives no rows.
    """
    vector = F.col("embedding").cast("array<double>")
    rows = embeddings.select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"),
        F.when(F.col("label").isNotNull() & _usable(vector), vector).alias("vector"), "label",
    )
    rows = written(rows, "vectors")
    usable = rows.filter("vector IS NOT NULL")
    classes = usable.groupBy("label", "vector").agg(
        F.min("row").alias("node"), F.min("vec_id").alias("least"), F.count("*").alias("held")
    )
    classes = written(classes, "vector_classes")
    chosen = choose_pivots(classes, pivots, nearest)
    found = _links(classes, chosen, threshold, nearest)

    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    components = connected_components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    labels = classes.join(linked, "node", "left").join(components, "node", "left")
    labels = labels.withColumn("component", F.coalesce("component", "node"))
    least = labels.groupBy("component").agg(F.min("least").alias("component_id"))
    labels = labels.join(least, "component").select(
        F.col("label").alias("of_label"), F.col("vector").alias("of_vector"), "component_id",
        (F.coalesce("links", F.lit(0)) + F.col("held") - 1).alias("n_links"),
    )
    labels = written(labels, "vector_labels")
    same = (F.col("label") == F.col("of_label")) & (F.col("vector") == F.col("of_vector"))
    out = rows.join(labels, same, "left")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(True)).alias("kept"),
    )
