"""Learning hash functions: principal components, and consensus learning of binary codes on a ring of nodes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecinity.functions.vectors import matrix
from vecinity.operators.families import PCAHash


def moments(items: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, sum and outer-product sum of all vectors: one pass, a d x d matrix per task, added pairwise by groups of tasks."""

    def run(batches):
        n, s, o = 0, 0, 0
        for batch in batches:
            if len(batch):
                x = matrix(batch.column(0))
                n, s, o = n + len(x), s + x.sum(0), o + x.T @ x
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([s.tobytes()], pa.binary()), pa.array([np.asarray(o).tobytes()], pa.binary())], ["n", "s", "o"])

    def add(key, table):
        cols = [sum(np.frombuffer(b) for b in table.column(c).to_pylist()) for c in ("s", "o")]
        return pa.table({"n": [sum(table.column("n").to_pylist())], "s": pa.array([cols[0].tobytes()], pa.binary()), "o": pa.array([cols[1].tobytes()], pa.binary())})

    kind = "n long, s binary, o binary"
    partial = items.select("vec").where("vec is not null").mapInArrow(run, kind).withColumn("g", F.spark_partition_id() % 32)
    rows = partial.groupBy("g").applyInArrow(lambda key, table: add(key, table), kind).collect()  # at most 32 rows
    if not rows:
        raise ValueError("no vectors to learn from")
    total = sum(np.frombuffer(r["s"]) for r in rows)
    outer = sum(np.frombuffer(r["o"]) for r in rows)
    return sum(r["n"] for r in rows), total, outer.reshape(len(total), -1)


def fit_pca(items: DataFrame, bits: int, tables: int = 1) -> PCAHash:
    """PCA hashing: table t takes principal directions t * bits to (t + 1) * bits - 1."""
    n, total, outer = moments(items)
    mean = total / n
    values, directions = np.linalg.eigh(outer / n - np.outer(mean, mean))
    best = directions[:, np.argsort(-values, kind="stable")[: bits * tables]].T
    best = best * np.sign(best[np.arange(len(best)), np.abs(best).argmax(1)])[:, None]
    return PCAHash(mean, best.reshape(tables, bits, -1))


#: Bytes that the matrices of all nodes of a ring may take on the driver.
RING_BYTES = 1 << 30


def with_node(items: DataFrame, per_node: int) -> DataFrame:
    """Items with the node that holds them: runs of per_node consecutive ids."""
    return items.select(F.floor(F.col("id") / per_node).cast("long").alias("node"), F.col("id").cast("long").alias("id"), "vec").where("id is not null and vec is not null")


def signs(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """sgn(C'x) of the rows of x, with 1 for 0."""
    return np.where(x @ c >= 0, 1.0, -1.0)


def products(nodes: DataFrame, matrices: dict[int, np.ndarray] | np.ndarray) -> dict[int, np.ndarray]:
    """B X' (bits x dim) of each node, B the signs of its items under its matrix: one pass over the data, a sum per task and node first."""
    of = (lambda node: matrices) if isinstance(matrices, np.ndarray) else matrices.__getitem__

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if not len(batch):
                continue
            node, x = np.asarray(batch.column(0)), matrix(batch.column(1))
            for k in np.unique(node).tolist():
                own = x[node == k]
                sums[k] = sums.get(k, 0) + signs(own, of(k)).T @ own
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([m.tobytes() for m in sums.values()], pa.binary())], ["node", "m"])

    def add(key, table):
        return pa.table({"node": [key[0].as_py()], "m": pa.array([sum(np.frombuffer(b) for b in table.column("m").to_pylist()).tobytes()], pa.binary())})

    summed = nodes.select("node", "vec").mapInArrow(run, "node long, m binary").groupBy("node").applyInArrow(lambda key, table: add(key, table), "node long, m binary")
    bits = (matrices if isinstance(matrices, np.ndarray) else next(iter(matrices.values()))).shape[1]
    return {r["node"]: np.frombuffer(r["m"]).reshape(bits, -1) for r in summed.toLocalIterator()}


def ring(found: dict[int, np.ndarray], rounds: int, rho: float = 0.1, again=None) -> dict[int, np.ndarray]:
    """Consensus on a ring over the nodes in ascending order: dim x bits matrices from B X' of each node.

    All start at C = I and L = 0.6 I. A round: S = 2 B X' - L' + rho (C1' + C2'), S = G Sigma H', C = H G', with C1 and C2 the neighbours' last
    matrices, then L += 2 rho (2 C - C1 - C2). `again` makes B X' anew from the matrices after a round."""
    names = sorted(found)
    m = np.stack([found[k] for k in names])
    n, bits, dim = m.shape
    if 4 * m.nbytes > RING_BYTES:
        raise ValueError(f"{n} nodes of {dim} x {bits} are more than {RING_BYTES} bytes; use fewer nodes")
    start = np.eye(dim, bits)
    c, dual = np.repeat(start[None], n, 0), np.repeat(0.6 * start[None], n, 0)
    for _ in range(rounds):
        near = np.roll(c, 1, 0) + np.roll(c, -1, 0)
        g, _, h = np.linalg.svd(2 * m - dual.transpose(0, 2, 1) + rho * near.transpose(0, 2, 1), full_matrices=False)
        c = (g @ h).transpose(0, 2, 1)
        dual = dual + 2 * rho * (2 * c - np.roll(c, 1, 0) - np.roll(c, -1, 0))
        if again is not None:
            fresh = again(dict(zip(names, c)))
            m = np.stack([fresh[k] for k in names])
    return dict(zip(names, c))


def fit_dish(items: DataFrame, code_length: int, per_node: int, rounds: int = 20, rho: float = 0.1, update_codes: bool = False) -> dict[int, np.ndarray]:
    """The hash matrix of each node, learned by consensus. B is fixed at sgn(C'X) of the first matrices unless update_codes (then the data are read each round)."""
    nodes = with_node(items, per_node)
    head = nodes.select(F.size("vec").alias("d")).head()
    if head is None:
        raise ValueError("no vectors to learn from")
    found = products(nodes, np.eye(head["d"], code_length))
    return ring(found, rounds, rho, (lambda c: products(nodes, c)) if update_codes else None)


def dish_codes(items: DataFrame, matrices: dict[int, np.ndarray], per_node: int) -> DataFrame:
    """(node, id, code): signs of C'x under the matrix of the item's own node, the first bit as the most significant."""
    from vecinity.operators.families import pack

    spark = items.sparkSession
    told = spark.createDataFrame([(int(k), c.shape[1], bytearray(np.ascontiguousarray(c).tobytes())) for k, c in matrices.items()], "node long, bits int, c binary")

    def run(key, own, model):
        if not len(own) or not len(model):
            return pa.table({"node": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "code": pa.array([], pa.int64())})
        c = np.frombuffer(model.column("c")[0].as_py()).reshape(-1, model.column("bits")[0].as_py())
        x = matrix(own.column("vec"))
        return pa.table({"node": own.column("node"), "id": own.column("id"), "code": pa.array(pack(signs(x, c) > 0))})

    return with_node(items, per_node).groupBy("node").cogroup(told.groupBy("node")).applyInArrow(run, "node long, id long, code long")
