"""Vector functions as columns, and the same over numpy batches.

Dense vectors are arrays of numbers, sparse ones arrays of (idx, val) structs in ascending idx. Sums are in double.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    """Inner product of two dense vectors."""
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def dot_sparse_dense(sparse: Column, dense: Column) -> Column:
    """Inner product of a sparse and a dense vector; indexes beyond the dense one count as 0."""
    return _sum(F.transform(sparse, lambda e: F.coalesce(F.get(dense, e["idx"]).cast("double"), F.lit(0.0)) * e["val"].cast("double")))


def dot_sparse(a: Column, b: Column) -> Column:
    """Inner product of two sparse vectors by lookup of the one's indexes in the other."""
    # The map is made once per row: a lambda's argument is evaluated before its body.
    products = lambda known: _sum(F.transform(a, lambda e: F.coalesce(known[e["idx"]].cast("double"), F.lit(0.0)) * e["val"].cast("double")))
    return F.get(F.transform(F.array(F.map_from_entries(b)), products), F.lit(0))


def norm(v: Column) -> Column:
    """Euclidean length of a dense vector."""
    return F.sqrt(dot(v, v))


def norm_sparse(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(v, lambda e: e["val"].cast("double") * e["val"].cast("double"))))


def square_e2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance."""
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def e2(a: Column, b: Column) -> Column:
    return F.sqrt(square_e2(a, b))


def angle(product: Column, norm_a: Column, norm_b: Column) -> Column:
    """Angle from a product and two norms; a product of 0 is a right angle, rounding never leaves [-1, 1]."""
    return F.acos(F.when(product == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), product / (norm_a * norm_b)))))


def angular(a: Column, b: Column, unit: bool = False) -> Column:
    """Angle between dense vectors; unit: both are known to have length 1."""
    return angle(dot(a, b), F.lit(1.0), F.lit(1.0)) if unit else angle(dot(a, b), norm(a), norm(b))


def angular_sparse(a: Column, b: Column) -> Column:
    return angle(dot_sparse(a, b), norm_sparse(a), norm_sparse(b))


def e2_sparse(a: Column, b: Column) -> Column:
    """Euclidean distance of sparse vectors, over all indexes of both."""
    squares = lambda v: _sum(F.transform(v, lambda e: e["val"].cast("double") * e["val"].cast("double")))
    return F.sqrt(F.greatest(F.lit(0.0), squares(a) + squares(b) - 2 * dot_sparse(a, b)))


def normalize(v: Column) -> Column:
    """The vector at length 1; null for one shorter than 1e-10."""
    n = norm(v)
    return F.when(n > 1e-10, F.transform(v, lambda x: x.cast("double") / n))


def normalize_sparse(v: Column) -> Column:
    n = norm_sparse(v)
    return F.when(n > 1e-10, F.transform(v, lambda e: F.struct(e["idx"].alias("idx"), (e["val"].cast("double") / n).alias("val"))))


def pack_bits(bits: Column) -> Column:
    """Bits, the first as the most significant one, as one number (63 at most)."""
    return F.aggregate(bits, F.lit(0).cast("long"), lambda s, b: s * 2 + b.cast("long"))


METRICS = {"sq_e2": square_e2, "e2": e2, "angular": angular}


def matrix(column: pa.Array) -> np.ndarray:
    """An Arrow list column as an n x dim matrix of doubles; all lists have one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    if n and len(flat) % n:
        raise ValueError("vectors of different dimension")
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def sparse_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indexes, values and offsets of an Arrow column of sparse vectors."""
    entries = column.flatten()
    offsets = np.asarray(column.offsets, np.int64)
    return np.asarray(entries.field("idx"), np.int64), np.asarray(entries.field("val"), np.float64), offsets - offsets[0]


def sparse_angles(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Angles of rows with equal places of two columns of sparse vectors, idx ascending: one search of all (row, idx) of b among those of a."""
    (ai, av, ao), (bi, bv, bo) = sparse_parts(a), sparse_parts(b)
    n = len(a)
    ar, br = np.repeat(np.arange(n), np.diff(ao)), np.repeat(np.arange(n), np.diff(bo))
    span = int(max(ai.max(initial=0), bi.max(initial=0))) + 1
    keys = ar * span + ai
    at = np.minimum(np.searchsorted(keys, br * span + bi), max(len(keys) - 1, 0))
    hit = keys[at] == br * span + bi if len(keys) else np.zeros(len(br), bool)
    product = np.bincount(br[hit], bv[hit] * av[at[hit]], n) if hit.any() else np.zeros(n)
    scale = np.sqrt(np.bincount(ar, av * av, n) * np.bincount(br, bv * bv, n))
    cosine = np.divide(product, scale, out=np.zeros(n), where=scale > 0)
    return np.arccos(np.clip(cosine, -1, 1))


def pairwise(metric, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of a (queries) to all rows of b, by one matrix product; a metric of one's own is a function of both matrices."""
    if callable(metric):
        return np.asarray(metric(a, b), float)
    product = a @ b.T
    if metric == "angular":
        scale = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :]
        return np.arccos(np.clip(np.divide(product, scale, out=np.zeros_like(product), where=scale > 0), -1, 1))
    square = np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * product, 0)
    return square if metric == "sq_e2" else np.sqrt(square)


def rowwise(metric, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of rows with equal places, without the cancellation of `pairwise`."""
    if callable(metric):
        return np.array([float(np.asarray(metric(x[None], y[None]))[0, 0]) for x, y in zip(a, b)])
    if metric == "angular":
        product, scale = (a * b).sum(1), np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)
        return np.arccos(np.clip(np.divide(product, scale, out=np.zeros_like(product), where=scale > 0), -1, 1))
    square = ((a - b) ** 2).sum(1)
    return square if metric == "sq_e2" else np.sqrt(square)
