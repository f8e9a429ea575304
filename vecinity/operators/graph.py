"""Proximity graphs: building them, exact and by neighbour descent, and what is computed on them.

A graph is an edge table (src, dst, dist). Iterative operators write each round to the shared folder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecinity.functions import vectors
from vecinity.operators.components import connected_components
from vecinity.operators.search import ROWS, self_scan, top_k
from vecinity.plans.lineage import discard, saved


def reverse(graph: DataFrame) -> DataFrame:
    """The edges turned around."""
    return graph.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in graph.columns if c not in ("src", "dst")])


def symmetric(graph: DataFrame) -> DataFrame:
    """Distinct (src, dst) in both directions."""
    e = graph.select("src", "dst")
    return e.unionAll(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()


def degree(graph: DataFrame) -> DataFrame:
    """(id, degree) in the undirected graph."""
    return symmetric(graph).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))


def in_degree(graph: DataFrame) -> DataFrame:
    """(id, indegree): the size of the reverse list of each vertex that has one."""
    return graph.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("indegree"))


def top_in_degree(graph: DataFrame, n: int) -> DataFrame:
    """The n vertices with the longest reverse lists; ties go to the smaller id."""
    return in_degree(graph).orderBy(F.desc("indegree"), "id").limit(n)


def exact_graph(items: DataFrame, k: int = 20, metric: str = "sq_e2") -> DataFrame:
    """The exact k-nearest-neighbour graph."""
    return top_k(self_scan(items, metric, k), k).select(F.col("query_id").alias("src"), F.col("item_id").alias("dst"), "dist", "rank")


def nearest(edges: DataFrame, k: int) -> DataFrame:
    """The k best distinct neighbours per vertex; ties go to the smaller id."""
    best = edges.groupBy("src", "dst").agg(F.min("dist").alias("dist"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy("dist", "dst"))).where(F.col("rank") <= k).drop("rank")


def with_distance(pairs: DataFrame, items: DataFrame, metric: str) -> DataFrame:
    """(src, dst, dist) of pairs."""
    a = items.select(F.col("id").alias("src"), F.col("vec").alias("a"))
    b = items.select(F.col("id").alias("dst"), F.col("vec").alias("b"))
    return pairs.join(a, "src").join(b, "dst").select("src", "dst", vectors.METRICS[metric](F.col("a"), F.col("b")).alias("dist"))


def random_graph(items: DataFrame, k: int, metric: str, seed: int = 0) -> DataFrame:
    """About k different neighbours a vertex by arithmetic on ids 0..n-1, with real distances, never the vertex itself."""
    n = items.agg(F.max("id")).first()[0]
    n = 0 if n is None else n + 1
    if n < 2:
        return with_distance(items.select(F.col("id").alias("src"), F.col("id").alias("dst")).where("false"), items, metric)
    step = F.expr(f"1 + pmod(src * 7919 + j * 104729 + j * j * 31 + {seed * 15485863}, {n - 1})")
    draws = items.select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(2 * k).cast("long"))).alias("j"))
    pairs = draws.select("src", F.pmod(F.col("src") + step, F.lit(n)).alias("dst")).distinct()
    return nearest(with_distance(pairs, items, metric), k)


#: Members of a vertex's surroundings that meet in one task.
MEET = 256


def cells_around(around: DataFrame) -> DataFrame:
    """(src, ba, bb, own, dst): the surroundings of each src in cells whose pairs are all its pairs.

    A hub's surroundings are cut into blocks of about MEET; each pair of blocks is a cell, where members of different blocks meet, and each block
    with itself is one, where all do."""
    blocks = around.groupBy("src").agg(F.ceil(F.count(F.lit(1)) / MEET).cast("int").alias("blocks"))
    placed = around.join(blocks, "src").withColumn("own", F.pmod(F.xxhash64("dst"), F.col("blocks")).cast("int"))
    told = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return told.select("src", F.least("own", "other").alias("ba"), F.greatest("own", "other").alias("bb"), "own", "dst")


def pairs_around(around: DataFrame) -> DataFrame:
    """Distinct (src, dst), src < dst, of all pairs of dst that stand around the same src; no task holds all of a hub's surroundings."""
    cells, keys = cells_around(around), ["src", "ba", "bb"]
    left, right = cells.select(*keys, F.col("own").alias("oa"), F.col("dst").alias("a")), cells.select(*keys, F.col("own").alias("ob"), F.col("dst").alias("b"))
    met = left.join(right, keys).where("a < b and (ba = bb or oa <> ob)")
    return met.select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()


def descent_round(graph: DataFrame, items: DataFrame, k: int, metric: str = "sq_e2", most_back: int | None = None) -> DataFrame:
    """One round of neighbour descent: all pairs among a vertex's neighbours and reverse neighbours compete for the lists of both.

    The reverse list is whole unless most_back cuts it to its so many nearest."""
    back = reverse(graph.select("src", "dst", "dist"))
    if most_back is not None:
        back = back.withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy("dist", "dst"))).where(F.col("r") <= most_back)
    around = graph.select("src", "dst").unionAll(back.select("src", "dst")).where("src <> dst").distinct()
    new = with_distance(pairs_around(around), items, metric)
    every = graph.select("src", "dst", "dist").unionAll(new).unionAll(new.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "dist"))
    return nearest(every, k)


def requested(graph: DataFrame, labels: DataFrame) -> DataFrame:
    """Distinct (label, id): the vectors that each block of vertices needs, its own and those of its neighbours."""
    own = labels.select("label", "id")
    return own.unionAll(graph.join(labels.select(F.col("id").alias("src"), "label"), "src").select("label", F.col("dst").alias("id"))).distinct()


def request_counts(graph: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, requests): how many different vectors each block needs."""
    return requested(graph, labels).groupBy("label").agg(F.count(F.lit(1)).alias("requests"))


#: Pairs, and numbers in vectors, that a task of a block-wise round holds at once.
PART_PAIRS = 1_000_000
PART_VALUES = 8_000_000


def parts_of_blocks(around: DataFrame, labels: DataFrame, dim: int) -> DataFrame:
    """(label, part, src, ba, bb, own, dst): the cells around the vertices of each block, dealt into parts of about PART_PAIRS pairs and PART_VALUES numbers."""
    cells = cells_around(around).join(labels.select(F.col("id").alias("src"), "label"), "src")
    sizes = cells.groupBy("label", "src", "ba", "bb").agg(F.count(F.lit(1)).alias("n")).groupBy("label").agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs"), F.sum("n").alias("members"))
    parts = sizes.select("label", F.greatest(F.ceil(F.col("pairs") / PART_PAIRS), F.ceil(F.col("members") * dim / PART_VALUES), F.lit(1)).alias("parts"))
    return cells.join(parts, "label").select("label", F.pmod(F.xxhash64("src", "ba", "bb"), F.col("parts")).cast("int").alias("part"), "src", "ba", "bb", "own", "dst")


def descent_round_blocks(graph: DataFrame, items: DataFrame, labels: DataFrame, k: int, metric: str = "sq_e2") -> DataFrame:
    """The round of `descent_round` for graphs whose vectors don't fit: vertices are grouped by label, and a part of a block gets each vector that it needs once.

    Blocks of any size are cut into parts of bounded size, hubs too; a part leaves each vertex its k nearest."""
    around = graph.select("src", "dst").unionAll(reverse(graph.select("src", "dst")).select("src", "dst")).where("src <> dst").distinct()
    usable = items.select("id", "vec").where("vec is not null")
    cells = saved(parts_of_blocks(around, labels, usable.agg(F.max(F.size("vec"))).first()[0] or 1), "cells")
    vecs = cells.select("label", "part", F.col("dst").alias("id")).distinct().join(usable, "id").select(F.col("label").alias("block"), F.col("part").alias("piece"), "id", "vec")

    def meet(near: pa.Table, known: pa.Table) -> pa.Table:
        none = pa.table({"src": pa.array([], pa.int64()), "dst": pa.array([], pa.int64()), "dist": pa.array([], pa.float64())})
        if not len(near) or not len(known):
            return none
        ids, x = np.asarray(known.column("id")), vectors.matrix(known.column("vec"))
        order = np.argsort(ids)
        ids, x = ids[order], x[order]
        src, ba, bb, own, dst = (np.asarray(near.column(c)) for c in ("src", "ba", "bb", "own", "dst"))
        at = np.minimum(np.searchsorted(ids, dst), len(ids) - 1)
        order = np.lexsort((at, bb, ba, src))
        order = order[ids[at[order]] == dst[order]]
        src, ba, bb, own, at = src[order], ba[order], bb[order], own[order], at[order]
        cuts = np.flatnonzero((np.diff(src) != 0) | (np.diff(ba) != 0) | (np.diff(bb) != 0)) + 1
        found = [np.zeros(0, np.int64)]
        for cell in np.split(np.arange(len(at)), cuts):
            left, right = np.triu_indices(len(cell), 1)
            left, right = cell[left], cell[right]
            if len(cell) and ba[cell[0]] != bb[cell[0]]:
                apart = own[left] != own[right]
                left, right = left[apart], right[apart]
            found.append(at[left] * len(ids) + at[right])
        pair = np.unique(np.concatenate(found))
        a, b = pair // len(ids), pair % len(ids)
        if not len(a):
            return none
        dist = np.concatenate([vectors.rowwise(metric, x[a[i : i + ROWS]], x[b[i : i + ROWS]]) for i in range(0, len(a), ROWS)])
        a, b, dist = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([dist, dist])
        by = np.lexsort((b, dist, a))
        by = by[np.arange(len(by)) - np.searchsorted(a[by], a[by]) < k]
        return pa.table({"src": ids[a[by]], "dst": ids[b[by]], "dist": dist[by]})

    new = cells.groupBy("label", "part").cogroup(vecs.groupBy("block", "piece")).applyInArrow(meet, "src long, dst long, dist double")
    return nearest(graph.select("src", "dst", "dist").unionAll(new), k)


def centers(items: DataFrame, n: int, seed: int) -> DataFrame:
    """A sample of n items by a hash of their ids: (center, vec)."""
    key = F.expr(f"pmod(id * 1103515245 + {12345 + seed * 7919}, 2147483648)")
    return items.withColumn("__k", key).orderBy("__k", "id").limit(n).select(F.col("id").alias("center"), "vec")


def assign_cells(items: DataFrame, books: list[DataFrame], metric: str = "sq_e2", nearest_centers: int = 1) -> DataFrame:
    """(id, book, rank, center): the nearest centers of each item in each book; ties go to the smaller center.

    Books hold a sample of about 2 sqrt(n) items each and go to every task as one matrix."""
    shared = items.sparkSession.sparkContext.broadcast([(np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)) for rows in (b.orderBy("center").collect() for b in books)])

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            x = vectors.matrix(batch.column(1))
            out = []
            for b, (ids, c) in enumerate(shared.value):
                d = np.round(vectors.pairwise(metric, x, c), 9)
                for r, k in enumerate(np.argsort(d, axis=1, kind="stable")[:, :nearest_centers].T):
                    out.append((np.full(len(x), b, np.int32), np.full(len(x), r, np.int32), ids[k]))
            ids = pa.concat_arrays([batch.column(0)] * len(out))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(np.concatenate([o[k] for o in out])) for k in range(3))], ["id", "book", "rank", "center"])

    return items.select(F.col("id").cast("long").alias("id"), "vec").mapInArrow(run, "id long, book int, rank int, center long")


def multi_index_cells(items: DataFrame, seed: int = 0, n: int | None = None) -> DataFrame:
    """(id, left_center, right_center): the cell of each item; both books are samples of int(2 sqrt(n)) whole vectors."""
    n = int(2 * items.count() ** 0.5) if n is None else n
    cells = assign_cells(items, [centers(items, n, seed), centers(items, n, seed + 1)])
    return cells.groupBy("id").agg(F.max(F.when(F.col("book") == 0, F.col("center"))).alias("left_center"), F.max(F.when(F.col("book") == 1, F.col("center"))).alias("right_center"))


def multi_index_seed(items: DataFrame, k: int = 20, metric: str = "sq_e2", seed: int = 0) -> DataFrame:
    """(src, dst, dist): nearest members of the int(sqrt(k)) x int(sqrt(k)) nearest cells of each item."""
    n, s = int(2 * items.count() ** 0.5), max(1, int(k**0.5))
    near = saved(assign_cells(items, [centers(items, n, seed), centers(items, n, seed + 1)], metric, s), "cells")
    side = lambda b, name: near.where(F.col("book") == b).select("id", F.col("rank").alias(f"r{b}"), F.col("center").alias(name))
    both = side(0, "left_center").join(side(1, "right_center"), "id")
    home = both.where("r0 = 0 and r1 = 0").select(F.col("id").alias("dst"), "left_center", "right_center")
    pairs = both.select(F.col("id").alias("src"), "left_center", "right_center").join(home, ["left_center", "right_center"]).where("src <> dst").select("src", "dst").distinct()
    return nearest(with_distance(pairs, items, metric), k)


def knn_graph(items: DataFrame, k: int = 20, max_iter: int = 10, init: str = "multi_index", metric: str = "sq_e2", seed: int = 0) -> DataFrame:
    """An approximate k-nearest-neighbour graph by neighbour descent; stops early when a round changes nothing."""
    graph = random_graph(items, k, metric, seed)
    if init == "multi_index":
        graph = nearest(graph.unionAll(multi_index_seed(items, k, metric, seed)), k)
    graph, before = saved(graph, "knn"), None
    for _ in range(max_iter):
        last, graph = graph, saved(descent_round(graph, items, k, metric), "knn")
        discard(last)
        now = graph.agg(F.round(F.sum("dist"), 9), F.count(F.lit(1))).first()
        if now == before:
            break
        before = now
    return graph


def component_sizes(labels: DataFrame) -> DataFrame:
    """(label, size) of components or clusters, largest first."""
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("size")).orderBy(F.desc("size"), "label")


def components_of(vertices: DataFrame, graph: DataFrame) -> DataFrame:
    """(id, label) of every vertex; those without edges are their own component."""
    found = connected_components(graph)
    return vertices.select("id").join(found, "id", "left").select("id", F.coalesce("label", "id").alias("label"))


def random_cluster(vertices: DataFrame, labels: list[int]) -> DataFrame:
    """(id, label): labels dealt by id modulo their number."""
    return vertices.select("id", F.get(F.array(*[F.lit(x).cast("long") for x in labels]), F.pmod("id", F.lit(len(labels))).cast("int")).alias("label"))


def hop_cluster(vertices: DataFrame, graph: DataFrame, hops: int) -> DataFrame:
    """(id, label): the smallest id within so many hops."""
    edges = saved(symmetric(graph), "hops")
    labels = vertices.select("id", F.col("id").alias("label"))
    for n in range(hops):
        told = edges.join(labels.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("label").alias("near"))
        labels = labels.join(told, "id", "left").select("id", F.least("label", "near").alias("label"))
        labels = saved(labels, "hops")
    return labels


def reset_labels(vertices: DataFrame) -> DataFrame:
    """(id, label): every vertex with its own id."""
    return vertices.select("id", F.col("id").alias("label"))


def propagate_labels(graph: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, label): the smallest label among a vertex's own and those of vertices with an edge to it."""
    told = graph.select("src", "dst").join(labels.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), "label")
    return told.unionAll(labels.select("id", "label")).groupBy("id").agg(F.min("label").alias("label")).join(labels.select("id"), "id", "left_semi")


def nth_labels(graph: DataFrame, labels: DataFrame, n: int) -> DataFrame:
    """(id, label): the n-th smallest different label among the neighbours of each vertex that has as many, n from 1."""
    told = graph.select("src", "dst").join(labels.select(F.col("id").alias("dst"), "label"), "dst").select(F.col("src").alias("id"), "label").distinct()
    return told.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("label"))).where(F.col("r") == n).select("id", "label")


def bfs_cluster(vertices: DataFrame, graph: DataFrame, seeds: list[int], max_rounds: int | None = None) -> DataFrame:
    """(id, label): breadth-first waves from all seeds at once; a vertex takes the most frequent label among those that reach it first
    (ties: the smallest); seeds keep their own id; what no wave reaches gets the largest seed plus 1. Runs until a wave is empty, or for max_rounds waves."""
    edges = saved(symmetric(graph), "bfs")
    done = saved(vertices.where(F.col("id").isin(list(seeds))).select("id", F.col("id").alias("label")), "bfs")
    wave, rounds = done, 0
    while max_rounds is None or rounds < max_rounds:
        rounds += 1
        votes = edges.join(wave.withColumnRenamed("id", "src"), "src").join(done.select(F.col("id").alias("dst")), "dst", "left_anti").groupBy("dst", "label").agg(F.count(F.lit(1)).alias("n"))
        first = votes.groupBy(F.col("dst").alias("id")).agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("label"))
        wave = saved(first, "bfs")
        if not wave.take(1):
            break
        done = done.unionAll(wave)
    rest = max(seeds, default=-1) + 1
    return vertices.select("id").join(done, "id", "left").select("id", F.coalesce("label", F.lit(rest)).cast("long").alias("label"))
