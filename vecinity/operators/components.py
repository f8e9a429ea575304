"""Connected components of an edge table by alternating star contractions.

Large star: every larger neighbour of a vertex is tied to the vertex's smallest neighbour; small star: the smaller ones and the
vertex itself are. Both keep components as they are, and a number of rounds logarithmic in practice leaves stars around each
component's smallest id. Each round is a minimum per vertex (pre-aggregated) and a join that Spark may split at hot
vertices; its result is written to the shared folder, so lineage stays short, and the round before is deleted.

A table of at most SMALL distinct edges is settled in one task instead: rounds over it would cost little but their start, once for each partition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecinity.plans.lineage import discard, saved


#: Distinct edges that one task holds at once (16 bytes each).
SMALL = 500_000


def settled(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vertices of edges u, v and the smallest vertex of each one's component.

    Roots hook to their smallest neighbouring root, then paths are halved until they are flat; two rounds at least halve the roots."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v = at[: len(u)], at[len(u) :]
    root = np.arange(len(ids))
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            return ids, ids[root]
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while ((up := root[root]) != root).any():
            root = up


def _settle(batches):
    found = [np.stack([np.asarray(c, np.int64) for c in batch.columns]) for batch in batches]
    u, v = np.concatenate(found, 1) if found else np.zeros((2, 0), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in settled(u, v)], ["id", "label"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u"), F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    tied = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", small: int = SMALL) -> DataFrame:
    """(id, label) of every vertex that has an edge to another one; label is the smallest id of its component.

    Null ends and self loops are left out; repeated edges count once; no edges give an empty table. Up to `small` edges are settled in one task."""
    now = saved(edges.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v")).where("u <> v").distinct(), "components")
    before = None
    while True:  # to the fixpoint: contraction only moves edges to smaller ids
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before is None and mark[0] <= small:
            out = saved(now.coalesce(1).mapInArrow(_settle, "id long, label long"), "components")
            discard(now)
            return out
        if mark == before or not mark[0]:
            break
        before, last = mark, now
        now = saved(_small_star(_large_star(last)), "components")
        discard(last)
    stars = now.select(F.greatest("u", "v").alias("id"), F.least("u", "v").alias("label"))
    return stars.unionAll(stars.select("label", "label").distinct().toDF("id", "label"))
