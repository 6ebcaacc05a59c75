"""Vector expressions over array columns, evaluated in double precision inside the JVM."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / (norm(a) * norm(b))


def similarity(distance: Column) -> Column:
    """1 - distance, with the distance held to [0, 2]; null where it is further off than rounding explains."""
    return F.when((distance >= -1e-6) & (distance <= 2 + 1e-6), 1 - F.greatest(F.lit(0.0), F.least(F.lit(2.0), distance)))


def usable(a: Column, dimension: int, slack: float = 1e-3) -> Column:
    """Right length, all components finite, unit length within slack."""
    finite = F.forall(a, lambda x: ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (F.size(a) == dimension) & finite & (F.abs(norm(a) - 1) <= slack)


def fixed_embedding(value: Column, purpose: str, dimension: int = 64) -> Column:
    """A deterministic unit vector of a text, salted by purpose: SHAKE-256 bytes as int32, normalised."""

    def run(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            raw = np.frombuffer(hashlib.shake_256(f"{purpose}\0{t}".encode()).digest(4 * dimension), ">i4").astype(np.float64)
            out.append((raw / np.linalg.norm(raw)).tolist())
        return pa.array(out, pa.list_(pa.float64()))

    return F.arrow_udf(run, "array<double>")(value)


def matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The lists of a column as rows in double precision, and which of them are whole: not null, of this width, without null components. Others are zero."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten()
    if not column.null_count and not flat.null_count and len(flat) == width * len(column) and np.all(column.value_lengths().to_numpy(zero_copy_only=False) == width):
        return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width), np.ones(len(column), bool)
    out, whole = np.zeros((len(column), width)), np.zeros(len(column), bool)
    for i, row in enumerate(column.to_pylist()):
        if row is not None and len(row) == width and None not in row:
            out[i], whole[i] = row, True
    return out, whole


def lengths(rows: np.ndarray) -> np.ndarray:
    """Norms of rows, summed component by component as `norm` does: the same bits."""
    total = np.zeros(len(rows))
    for c in range(rows.shape[1]):
        total += rows[:, c] * rows[:, c]
    return np.sqrt(total)


def distances(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Cosine distances of pairs of rows with their norms, summed as `cosine_distance` does: the same bits."""
    total = np.zeros(len(a))
    for c in range(a.shape[1]):
        total += a[:, c] * b[:, c]
    return 1 - total / (na * nb)
