"""Dense-vector column expressions (JVM side) and Arrow/NumPy batch helpers.

Vectors are ``ARRAY<FLOAT>`` (or ``ARRAY<DOUBLE>``) columns. All arithmetic is
done in double. Spark 4.1 has no built-in vector functions, so the column
helpers are higher-order SQL functions; the NumPy helpers are used inside
``mapInArrow`` / ``applyInArrow`` tasks where a whole batch is one matrix.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _zero() -> Column:
    return F.lit(0.0).cast("double")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a, b) -> Column:
    """Inner product of two vectors, summed in double."""
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")), _zero(),
                       lambda acc, v: acc + v)


def sq_l2(a, b) -> Column:
    """Squared Euclidean distance."""
    return F.aggregate(
        F.zip_with(_col(a), _col(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))),
        _zero(), lambda acc, v: acc + v)


def norm(a) -> Column:
    """Euclidean norm."""
    return F.sqrt(F.aggregate(_col(a), _zero(), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalize(a) -> Column:
    """``v / ||v||``; a zero vector stays zero. Result is ``ARRAY<DOUBLE>``."""
    v = _col(a)
    # the norm is bound once as a one-element array; inside the lambda of a
    # plain transform it would be computed again for every element
    n = F.transform(F.array(norm(v)), lambda x: F.when(x == 0, F.lit(1.0)).otherwise(x))
    return F.element_at(F.transform(n, lambda d: F.transform(v, lambda x: x.cast("double") / d)), 1)


def is_zero(a) -> Column:
    """True when every element is 0 (the padding test of masked mean)."""
    return F.forall(_col(a), lambda x: x == 0)


# ---------------------------------------------------------------- NumPy side

def list_column_to_matrix(col: pa.Array | pa.ChunkedArray, dtype=np.float64) -> np.ndarray:
    """A list<float> Arrow column of equal-length rows -> (n, d) matrix.

    Null rows are not allowed (a vector is required).
    """
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    if n == 0:
        return np.zeros((0, 0), dtype=dtype)
    if col.null_count:
        raise ValueError("null vector in a vector column")
    offsets = col.offsets.to_numpy()
    lengths = np.diff(offsets)
    d = int(lengths[0])
    if not np.all(lengths == d):
        raise ValueError(f"vectors of different dimension in one column: {sorted(set(lengths.tolist()))[:5]}")
    values = col.flatten().to_numpy(zero_copy_only=False)
    return values.astype(dtype, copy=False).reshape(n, d)


def normalize_rows(m: np.ndarray) -> np.ndarray:
    norms = np.sqrt((m * m).sum(axis=1))  # each row on its own: no influence of its place in a batch
    safe = np.where(norms == 0, 1, norms).astype(m.dtype)
    return m / safe[:, None]


def matrix_to_list_array(m: np.ndarray, value_type=pa.float32()) -> pa.ListArray:
    n, d = m.shape
    offsets = pa.array(np.arange(0, (n + 1) * d, d, dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(m.reshape(-1), type=value_type))
