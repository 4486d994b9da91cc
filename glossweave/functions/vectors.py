"""Vector columns: usable vectors, norms, products and means."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_usable(c: Column | str, dim: int) -> Column:
    """Exactly ``dim`` elements, all finite, not all zero."""
    c = F.col(c) if isinstance(c, str) else c
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(c) == dim) & finite & F.exists(c, lambda x: x != 0), F.lit(False))


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product of two arrays of the same length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    """Euclidean length of an array."""
    return F.sqrt(dot(a, a))


def _unit_lists(v: pa.Array) -> pa.Array:
    """Lists of any length divided by their Euclidean lengths; zero lists as they are, nulls stay."""
    flat = v.flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    sizes = np.array(v.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    ends = np.cumsum(sizes)
    length = np.sqrt(np.add.reduceat(np.append(x * x, 0.0), ends - sizes)) * (sizes > 0) if len(sizes) else np.zeros(0)
    out = x / np.repeat(np.where(length == 0, 1.0, length), sizes)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(out, pa.float64(), mask=flat.is_null().to_numpy(zero_copy_only=False)), mask=v.is_null())


def l2_normalise(a: Column | str) -> Column:
    """The array divided by its length; a zero array stays as it is.

    An Arrow function: a higher-order expression would work out the length again for every element.
    """
    return F.arrow_udf(_unit_lists, "array<double>")(a)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two arrays; null when either is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def unit_rows(vectors: pa.ListArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Of an Arrow list column without null lists, all of ``dim`` elements: which rows are usable, and those as unit vectors."""
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, dim)
    ok = np.isfinite(x).all(axis=1)
    top = np.abs(np.where(ok[:, None], x, 0)).max(axis=1, initial=0)
    ok &= top > 0
    x = x[ok] / top[ok, None]  # against overflow and underflow of the squares
    return ok, x / np.sqrt((x * x).sum(axis=1))[:, None]


def mean_vectors(df: DataFrame, keys: list[str], vector: str, out: str = "embed", dim: int | None = None) -> DataFrame:
    """Element-wise mean of ``vector`` per key. Null keys are dropped.

    With ``dim``, vectors of that length without nulls are added up whole, on the map side first, and others
    are left out. Without it lengths may differ and elements be null: partial sums are kept per (key, position).
    """
    rows = df
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    if dim is not None:
        from pyspark.ml.functions import array_to_vector, vector_to_array
        from pyspark.ml.stat import Summarizer

        whole = rows.where((F.size(vector) == dim) & F.forall(vector, lambda x: x.isNotNull()))
        return whole.groupBy(*keys).agg(vector_to_array(Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>")))).alias(out))
    cells = rows.select(*keys, F.posexplode(vector).alias("pos", "val")).groupBy(*keys, "pos").agg(F.avg("val").alias("val"))
    packed = cells.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "val"))).alias("cells"))
    return packed.select(*keys, F.transform("cells", lambda c: c["val"]).alias(out))
