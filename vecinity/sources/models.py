"""Model files of hash families, read on the driver: they are as large as the family's matrices."""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession

from vecinity.operators.families import PCAHash, RotatedPCAHash
from vecinity.sources.binary import place


def parse_pca(text: str) -> PCAHash:
    """A text model: `tables features bits items queries`, the mean, then per table features x bits numbers (transposed)."""
    values = text.split()
    tables, features, bits = (int(x) for x in values[:3])
    rest = np.array(values[5:], float)
    if len(rest) != features * (1 + tables * bits):
        raise ValueError("the model's size and header differ")
    blocks = rest[features:].reshape(tables, features, bits).transpose(0, 2, 1)
    return PCAHash(rest[:features], blocks)


def read_pca(spark: SparkSession, path: str) -> PCAHash:
    return parse_pca("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))


def write_pca(family: PCAHash) -> str:
    """The text of a model."""
    tables, bits, features = family.components.shape
    row = lambda x: " ".join(repr(float(v)) for v in x)
    return "\n".join([f"{tables} {features} {bits} 0 0", row(family.mean), *(row(r) for t in family.components for r in t.T)]) + "\n"


def read_rotated(path: str) -> RotatedPCAHash:
    """A binary model: int32 M, L, D, N, S; L x M random numbers and L tables are skipped; N rows of D principal and N rotation floats. L must be 1."""
    system, base = place(path)
    with system.open_input_file(base) as f:
        raw = f.read()
    m, tables, d, n, s = np.frombuffer(raw, "<i4", 5)
    if tables != 1:
        raise ValueError("only models of one table")
    rows = np.frombuffer(raw[-4 * int(n) * int(d + n) :], "<f4").reshape(n, d + n)
    return RotatedPCAHash(rows[:, :d], rows[:, d:])
