"""Hash families: codes of vectors per table, from one matrix product a batch.

A family has `tables` tables; a table's signature is an array of longs, and two vectors meet in a table if their signatures are
equal. Coefficients come from a seeded generator, rounded, so that they can be written down elsewhere.
"""

from __future__ import annotations

from abc import ABC, abstractmethod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecinity.functions.vectors import matrix

DIGITS = 6


def pack(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as numbers, the first bit as the most significant; at most 63."""
    return bits.astype(np.int64) @ (1 << np.arange(bits.shape[1] - 1, -1, -1, dtype=np.int64))


class HashFamily(ABC):
    """What all families share. `directions` (functions x dim) and `offsets` define the projections."""

    tables: int
    metric: str
    directions: np.ndarray
    offsets: np.ndarray

    @property
    def dim(self) -> int:
        return self.directions.shape[1]

    def project(self, x: np.ndarray) -> np.ndarray:
        """All projections of the rows of x."""
        return x @ self.directions.T + self.offsets

    @abstractmethod
    def codes(self, x: np.ndarray) -> np.ndarray:
        """n x tables x width signature numbers of the rows of x."""

    def projections(self, items: DataFrame) -> DataFrame:
        """(id, fn, proj): each projection of each item."""

        def run(batches):
            for batch in batches:
                p = self.project(matrix(batch.column(1)))
                n, m = p.shape if len(batch) else (0, 0)
                ids = batch.column(0).take(pa.array(np.repeat(np.arange(n), m)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(np.arange(m, dtype=np.int32), n)), pa.array(p.reshape(-1))], ["id", "fn", "proj"])

        return self._usable(items).mapInArrow(run, "id long, fn int, proj double")

    def signatures(self, items: DataFrame) -> DataFrame:
        """(id, table, sig) for items (id, vec): one row per table."""

        def run(batches):
            for batch in batches:
                if not len(batch):
                    continue
                c = self.codes(matrix(batch.column(1)))
                n, t, w = c.shape
                sig = pa.ListArray.from_arrays(pa.array(np.arange(0, n * t * w + 1, w, dtype=np.int32)), pa.array(c.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(n), t))), pa.array(np.tile(np.arange(t, dtype=np.int32), n)), sig], ["id", "table", "sig"])

        return self._usable(items).mapInArrow(run, "id long, table int, sig array<long>")

    def _usable(self, items: DataFrame) -> DataFrame:
        """Items whose vectors have this family's dimension; others (null vectors too) can't be hashed."""
        return items.select(F.col("id").cast("long").alias("id"), "vec").where(F.size("vec") == self.dim)

    def functions(self, spark) -> DataFrame:
        """(fn, pos, a, b): the coefficients and offset of each function, a row per dimension."""
        rows = [(f, k, float(x), float(self.offsets[f])) for f, a in enumerate(self.directions) for k, x in enumerate(a)]
        return spark.createDataFrame(rows, "fn int, pos int, a double, b double")

    def describe(self) -> dict:
        """The family's parameters."""
        return {"family": type(self).__name__, "tables": self.tables, "dim": self.dim, "metric": self.metric, "directions": self.directions.tolist(), "offsets": self.offsets.tolist()}


class E2LSH(HashFamily):
    """p-stable hashing: floor((a v + b) / width), rows functions a table."""

    metric = "e2"

    def __init__(self, tables: int, rows: int, dim: int, width: float, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.tables, self.rows, self.width = tables, rows, float(width)
        self.directions = np.round(rng.standard_normal((tables * rows, dim)), DIGITS)
        self.offsets = np.round(rng.uniform(0, width, tables * rows), DIGITS)

    def codes(self, x):
        return np.floor(self.project(x) / self.width).astype(np.int64).reshape(len(x), self.tables, self.rows)

    def residuals(self, items: DataFrame) -> DataFrame:
        """(id, fn, residual): how far each projection lies above the lower border of its cell."""
        return self.projections(items).select("id", "fn", (F.col("proj") - F.floor(F.col("proj") / self.width) * self.width).alias("residual"))


class SimHash(HashFamily):
    """Signs of random projections (at least 0 is 1), packed per table."""

    metric = "angular"

    def __init__(self, tables: int, rows: int, dim: int, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.tables, self.rows = tables, rows
        a = rng.standard_normal((tables * rows, dim))
        self.directions = np.round(a / np.linalg.norm(a, axis=1, keepdims=True), DIGITS)
        self.offsets = np.zeros(tables * rows)

    def codes(self, x):
        return pack((self.project(x) >= 0).reshape(-1, self.rows)).reshape(len(x), self.tables, 1)


class AllPairsSimHash(SimHash):
    """m half signatures of rows / 2 bits make m (m - 1) / 2 tables: each pair of halves, in lexicographic order."""

    def __init__(self, tables: int, rows: int, dim: int, seed: int = 0):
        halves = int(round((1 + (1 + 8 * tables) ** 0.5) / 2))
        if halves * (halves - 1) // 2 != tables or rows % 2:
            raise ValueError("tables must be m (m - 1) / 2 and rows even")
        super().__init__(halves, rows // 2, dim, seed)
        self.halves, self.half, self.tables, self.rows = halves, rows // 2, tables, rows

    def codes(self, x):
        half = pack((self.project(x) >= 0).reshape(-1, self.half)).reshape(len(x), self.halves)
        left, right = np.triu_indices(self.halves, 1)
        return ((half[:, left] << self.half) | half[:, right])[:, :, None]


class PCAHash(HashFamily):
    """Signs of centred projections on given principal directions, one code of at most 63 bits a table."""

    metric = "e2"

    def __init__(self, mean: np.ndarray, components: np.ndarray):
        """components: tables x bits x dim."""
        self.mean, self.components = np.asarray(mean, float), np.asarray(components, float)
        self.tables, self.bits = self.components.shape[:2]
        self.directions = self.components.reshape(self.tables * self.bits, -1)
        self.offsets = -self.directions @ self.mean

    def codes(self, x):
        return pack((self.project(x) >= 0).reshape(-1, self.bits)).reshape(len(x), self.tables, 1)


class RotatedPCAHash(HashFamily):
    """Principal directions and a learned rotation folded into one matrix; a bit is set above 0 (strictly). One table."""

    metric, tables = "e2", 1

    def __init__(self, components: np.ndarray, rotation: np.ndarray):
        self.directions = np.asarray(rotation, float) @ np.asarray(components, float)
        self.offsets, self.bits = np.zeros(len(self.directions)), len(self.directions)

    def codes(self, x):
        return pack(self.project(x) > 0).reshape(len(x), 1, 1)


#: Parameters of the sparse coefficients: a prime and multipliers.
PRIME = 1_000_003
MULTIPLIERS = ((7_919, 104_729, 13), (15_485_863, 32_452_843, 29), (49_979_687, 67_867_967, 71))


class SparseSimHash:
    """SimHash for sparse vectors of any dimension: coefficients come from arithmetic on (function, index), none are stored.

    Each is the sum of three cubic residues, roughly normal. Signatures are segment sums over a batch's entries, so no projection
    matrix exists anywhere."""

    metric = "angular"

    def __init__(self, tables: int, rows: int, all_pairs: bool = False):
        self.tables, self.rows, self.all_pairs = tables, rows, all_pairs
        self.halves = int(round((1 + (1 + 8 * tables) ** 0.5) / 2)) if all_pairs else tables
        if all_pairs and (self.halves * (self.halves - 1) // 2 != tables or rows % 2):
            raise ValueError("tables must be m (m - 1) / 2 and rows even")
        self.half = rows // 2 if all_pairs else rows

    @staticmethod
    def coefficient(idx: str, fn: str) -> str:
        """SQL of a coefficient; works in Spark and elsewhere alike."""
        parts = []
        for p, q, r in MULTIPLIERS:
            t = f"((({idx} + 1) * {p} + ({fn} + 1) * {q}) % {PRIME})"
            parts.append(f"(((({t} * {t}) % {PRIME}) * {t} + {r}) % {PRIME})")
        return f"({' + '.join(parts)} - {3 * PRIME // 2})"

    @staticmethod
    def coefficients(idx: np.ndarray, fn: int) -> np.ndarray:
        """The same in numpy."""
        rest = lambda x: x - x // PRIME * PRIME  # noqa: E731  # numpy divides by a constant several times faster than it takes remainders
        out = np.full(len(idx), -(3 * PRIME // 2), np.int64)
        for p, q, r in MULTIPLIERS:
            t = rest((idx + 1) * p + (fn + 1) * q)
            out += rest(rest(t * t) * t + r)
        return out

    def codes(self, idx: np.ndarray, val: np.ndarray, first: np.ndarray) -> np.ndarray:
        """n x tables signatures of vectors whose entries begin at `first` (none empty)."""
        known, at = np.unique(idx, return_inverse=True)  # an index's coefficients are computed once a batch
        bits = np.stack([np.add.reduceat(val * self.coefficients(known, f)[at], first) >= 0 for f in range(self.halves * self.half)], 1)
        half = pack(bits.reshape(-1, self.half)).reshape(len(first), self.halves)
        if not self.all_pairs:
            return half
        left, right = np.triu_indices(self.halves, 1)
        return (half[:, left] << self.half) | half[:, right]

    def signatures(self, items: DataFrame) -> DataFrame:
        """(id, table, sig) for items (id, vec of (idx, val)); an empty vector has no signature."""

        def run(batches):
            for batch in batches:
                if not len(batch):
                    continue
                vec = batch.column(1)
                size = np.diff(np.asarray(vec.offsets))
                entries = vec.flatten()
                c = self.codes(np.asarray(entries.field("idx"), np.int64), np.asarray(entries.field("val"), float), np.cumsum(size) - size)
                n, t = c.shape
                sig = pa.ListArray.from_arrays(pa.array(np.arange(n * t + 1, dtype=np.int32)), pa.array(c.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(n), t))), pa.array(np.tile(np.arange(t, dtype=np.int32), n)), sig], ["id", "table", "sig"])

        usable = items.select(F.col("id").cast("long").alias("id"), F.transform("vec", lambda e: F.struct(e["idx"].cast("long").alias("idx"), e["val"].cast("double").alias("val"))).alias("vec"))
        return usable.where(F.size("vec") > 0).mapInArrow(run, "id long, table int, sig array<long>")
