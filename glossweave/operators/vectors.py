"""Vector operators over all rows: moments, principal components, nearest neighbours, centroids, encoders."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossweave.functions.vectors import dot, mean_vectors, norm, unit_rows
from glossweave.operators.skew import heavy_light_lookup

#: Tasks in which partial sums are added before the driver gets them.
FAN_IN = 32
#: Queries that one pass of an exact search sends to the executors.
QUERY_BLOCK = 4096


def sum_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray | None:
    """The sum of ``fn``'s arrays over all batches; None without rows. At most ``FAN_IN`` arrays reach the driver."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = None
        for b in batches:
            if b.num_rows:
                x = np.asarray(fn(b), dtype=np.float64).ravel()
                total = x if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % FAN_IN], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["k", "x"])

    def add(t: pa.Table) -> pa.Table:
        return pa.table({"x": pa.array([sum(np.frombuffer(v.as_py(), dtype=np.float64) for v in t.column("x")).tobytes()], pa.binary())})

    rows = df.mapInArrow(part, "k int, x binary").groupBy("k").applyInArrow(add, "x binary").collect()
    return sum(np.frombuffer(bytes(r["x"]), dtype=np.float64) for r in rows) if rows else None


@dataclass(frozen=True)
class PcaModel:
    """Principal components of unit vectors: ``mean`` (d), ``components`` (k, d), ``variances`` (k, with n - 1)."""

    mean: np.ndarray
    components: np.ndarray
    variances: np.ndarray

    @staticmethod
    def fit(df: DataFrame, vector: str, dim: int, k: int) -> PcaModel:
        """From the moments of all usable rows; at most ``k`` components (M2)."""

        def moments(b: pa.RecordBatch) -> np.ndarray:
            u = unit_rows(b.column(0), dim)[1]
            return np.concatenate([[len(u)], u.sum(axis=0), (u.T @ u).ravel()])

        m = sum_batches(df.where(F.size(vector) == dim).select(vector), moments)
        if m is None or m[0] < 2:
            raise ValueError("at least two usable vectors are needed")
        n, mean = m[0], m[1 : 1 + dim] / m[0]
        cov = (m[1 + dim :].reshape(dim, dim) - n * np.outer(mean, mean)) / (n - 1)
        values, axes = np.linalg.eigh(cov)
        k = min(k, dim, int(n))
        comps = axes[:, ::-1][:, :k].T
        signs = np.sign(comps[np.arange(k), np.abs(comps).argmax(axis=1)])
        return PcaModel(mean, comps * signs[:, None], np.maximum(values[::-1][:k], 0.0))

    def transform(self, df: DataFrame, vector: str) -> DataFrame:
        """The frame with ``p`` (coordinates), ``pca_residual``, ``pca_mahalanobis``, ``pca_spectral_entropy`` (M3 to M6).

        Rows with an unusable vector get nulls.
        """
        model, dim = self, len(self.mean)

        def score(v: pa.Array) -> pa.Array:
            ok = np.array([x is not None and len(x) == dim for x in v.to_pylist()]) if v.null_count or len(v) == 0 or not (np.diff(v.offsets.to_numpy()) == dim).all() else np.ones(len(v), bool)
            good, u = unit_rows(v.filter(pa.array(ok)), dim) if ok.any() else (np.zeros(0, bool), np.zeros((0, dim)))
            at = np.nonzero(ok)[0][good]
            x = u - model.mean
            z = x @ model.components.T
            out = np.full((len(v), 3), np.nan)
            out[at, 0] = np.sqrt(np.maximum((x * x).sum(axis=1) - (z * z).sum(axis=1), 0))
            out[at, 1] = np.sqrt((z * z / np.maximum(model.variances, 1e-12)).sum(axis=1))
            p = z * z / np.maximum((z * z).sum(axis=1, keepdims=True), 1e-12)
            out[at, 2] = -(p * np.log(p + 1e-10)).sum(axis=1)
            missing = pa.array(np.isnan(out[:, 0]))
            coords = np.zeros((len(v), z.shape[1]))
            coords[at] = z
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * z.shape[1], pa.int32()), pa.array(coords.ravel()), mask=missing)
            cols = [pa.array(out[:, i], pa.float64(), mask=missing.to_numpy(zero_copy_only=False)) for i in range(3)]
            return pa.StructArray.from_arrays([lists, *cols], ["p", "pca_residual", "pca_mahalanobis", "pca_spectral_entropy"])

        scored = F.arrow_udf(score, "struct<p:array<double>,pca_residual:double,pca_mahalanobis:double,pca_spectral_entropy:double>")
        return df.withColumn("__s", scored(F.col(vector))).select("*", "__s.*").drop("__s")


def reduce_dimensions(df: DataFrame, vector: str, dim: int, k: int, out: str = "u") -> DataFrame:
    """The frame with ``k`` principal coordinates, the deterministic stand-in for a neighbour embedding."""
    return PcaModel.fit(df, vector, dim, k).transform(df, vector).withColumnRenamed("p", out).drop("pca_residual", "pca_mahalanobis", "pca_spectral_entropy")


def wide_coordinates(df: DataFrame, column: str, prefix: str, k: int) -> DataFrame:
    """Coordinates as columns <prefix>_00 onwards (M7)."""
    return df.select("*", *[F.get(column, F.lit(i)).alias(f"{prefix}_{i:02d}") for i in range(k)]).drop(column)


def nearest_exact(queries: DataFrame, base: DataFrame, k: int, dim: int) -> DataFrame:
    """(query, other, cosine): the exact ``k`` most similar rows of ``base`` for every row of ``queries``, not itself.

    Both have ``id`` (long) and ``embed``. Queries go to the executors in blocks of at most
    ``QUERY_BLOCK`` rows, for each of which the base is scanned once; every batch keeps its own best k.
    Equal cosines are ordered by the smaller id. Unusable vectors are no one's neighbours.
    """
    out, block = None, []

    def search(ids: np.ndarray, u: np.ndarray) -> DataFrame:
        shared = base.sparkSession.sparkContext.broadcast((ids, u))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, u = shared.value
            for b in batches:
                ok, v = unit_rows(b.column(1), dim)
                if not len(v):
                    continue
                other = b.column(0).filter(pa.array(ok)).to_numpy()
                c = u @ v.T
                c[ids[:, None] == other[None, :]] = -2
                take = min(k, c.shape[1])
                kth = -np.partition(-c, take - 1, axis=1)[:, take - 1]
                q, o = np.nonzero((c >= kth[:, None]) & (c > -2))
                yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(other[o]), pa.array(c[q, o])], ["query", "other", "cosine"])

        return base.where(F.col("id").isNotNull() & (F.size("embed") == dim)).select(F.col("id").cast("long"), "embed").mapInArrow(run, "query long, other long, cosine double")

    rows = queries.where(F.col("id").isNotNull() & (F.size("embed") == dim)).select(F.col("id").cast("long"), "embed").toLocalIterator()
    while True:
        block = [r for _, r in zip(range(QUERY_BLOCK), rows)]
        if not block:
            break
        ok, u = unit_rows(pa.array([r["embed"] for r in block], pa.list_(pa.float64())), dim)
        part = search(np.array([r["id"] for r in block])[ok], u)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return queries.sparkSession.createDataFrame([], "query long, other long, cosine double")
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.round("cosine", 9).desc(), "other"))
    return out.withColumn("r", best).where(F.col("r") <= k).withColumnRenamed("r", "rank")


def near_duplicate_edges(near: DataFrame, rank: int = 20) -> DataFrame:
    """Pairs at least as similar as the ``rank``-th most similar pair (M15); ``near`` holds each row's neighbours."""
    pairs = near.select(F.least("query", "other").alias("a"), F.greatest("query", "other").alias("b"), F.round("cosine", 9).alias("cosine")).distinct()
    kth = [r["cosine"] for r in pairs.orderBy(F.desc("cosine")).limit(rank).select("cosine").collect()]
    return pairs.where(F.col("cosine") >= F.lit(kth[-1] if kth else 2.0))


def centroid_cosines(df: DataFrame, key: str, vector: str, dim: int | None = None) -> DataFrame:
    """The frame with the cosine of every row to its group's mean vector (M17). A hot group's mean is broadcast."""
    means = mean_vectors(df, [key], vector, "__mean", dim)
    joined = heavy_light_lookup(df, means, key, "inner")
    return joined.withColumn("to_centroid", F.try_divide(dot(vector, "__mean"), norm(vector) * norm("__mean"))).drop("__mean")


def text_embeddings(chunks: DataFrame, texts: DataFrame, dim: int) -> DataFrame:
    """(doc, embed): mean of each text's chunk vectors, zeros for a text without any."""
    means = mean_vectors(chunks, ["doc"], "embed", dim=dim)
    return texts.select("doc").join(means, "doc", "left").withColumn("embed", F.coalesce("embed", F.array_repeat(F.lit(0.0), dim)))


def span_vector(tokens: Column, a: Column, b: Column, dim: int) -> Column:
    """Mean of the token vectors (structs with ix and vec) whose start lies in [a, b) (M8)."""
    inside = F.filter(tokens, lambda t: (t["ix"] >= a) & (t["ix"] < b))
    total = F.aggregate(inside, F.array_repeat(F.lit(0.0), dim), lambda s, t: F.zip_with(s, t["vec"], lambda x, y: x + y))
    return F.when(F.size(inside) > 0, F.transform(total, lambda x: x / F.size(inside)))


def pooled_text_vector(layers: Column, dim: int, padded: Column | int) -> Column:
    """One vector of a text from its tokens' layer vectors (M9).

    ``layers`` is array<array<array<double>>>: token, layer, element. Layers are averaged, token vectors brought to
    length one (a zero one stays), averaged over ``padded`` places (padding counts as zero vectors), and the
    result is brought to length one. Null for no token.
    """
    zero, length = F.array_repeat(F.lit(0.0), dim), lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    plus = lambda s, v: F.zip_with(s, v, lambda x, y: x + y)
    unit = lambda v, n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(x))
    means = F.transform(layers, lambda t: F.transform(F.aggregate(t, zero, plus), lambda x: x / F.size(t)))
    units = F.transform(F.transform(means, lambda v: F.struct(v.alias("v"), length(v).alias("n"))), lambda s: unit(s["v"], s["n"]))
    mean = F.transform(F.aggregate(units, zero, plus), lambda x: x / padded)
    return F.when(F.size(layers) > 0, F.element_at(F.transform(F.array(F.struct(mean.alias("v"), length(mean).alias("n"))), lambda s: unit(s["v"], s["n"])), 1))


class HashingEncoder:
    """A deterministic stand-in for a language model: words become sums of hashed character n-grams.

    "Layers" are n-gram lengths; a text's vector is the mean over layers and words.
    """

    def __init__(self, dim: int = 64, layers: tuple[int, ...] = (2, 3, 4)):
        self.dim, self.layers = dim, layers

    def word(self, w: str) -> np.ndarray:
        """The mean over layers of a word's n-gram vectors."""
        out = np.zeros(self.dim)
        padded = f"<{w.lower()}>"
        for n in self.layers:
            for i in range(max(1, len(padded) - n + 1)):
                h = hashlib.blake2b(padded[i : i + n].encode(), digest_size=8).digest()
                v = int.from_bytes(h, "little")
                out[v % self.dim] += 1.0 if v >> 63 else -1.0
        return out / len(self.layers)

    def column(self, text: Column | str) -> Column:
        """array<double>: the mean of the words' vectors; zeros for a text without words, null for null."""
        encoder = self

        def encode(texts: pa.Array) -> pa.Array:
            seen: dict[str, np.ndarray] = {}
            out = np.zeros((len(texts), encoder.dim))
            for i, t in enumerate(texts):
                ws = (t.as_py() or "").split()
                for w in ws:
                    if w not in seen:
                        seen[w] = encoder.word(w)
                    out[i] += seen[w]
                out[i] /= max(1, len(ws))
            return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * encoder.dim, pa.int32()), pa.array(out.ravel()), mask=texts.is_null())

        return F.arrow_udf(encode, "array<double>")(text)


def generality(near: DataFrame, simplicity: DataFrame, weight: float = 0.5) -> DataFrame:
    """(id, score): scaled log density of neighbours and scaled log simplicity of the label, mixed.

    ``near`` has (query, cosine) of each row's nearest others, ``simplicity`` has (id, simplicity). A
    constant measure counts as one for every row (trap X8).
    """
    dense = near.groupBy(F.col("query").alias("id")).agg(F.ln(F.greatest(F.avg("cosine"), F.lit(1e-12))).alias("x"))
    both = simplicity.select("id", F.ln(F.greatest("simplicity", F.lit(1e-300))).alias("y")).join(dense, "id", "left")
    m = both.agg(*[f(c).alias(f"{n}{c}") for c in "xy" for f, n in ((F.min, "lo"), (F.max, "hi"))])
    scaled = lambda c: F.when(F.col(f"hi{c}") > F.col(f"lo{c}"), (F.col(c) - F.col(f"lo{c}")) / (F.col(f"hi{c}") - F.col(f"lo{c}"))).otherwise(1.0)
    return both.join(F.broadcast(m), F.lit(True)).select("id", (weight * F.coalesce(scaled("x"), F.lit(1.0)) + (1 - weight) * scaled("y")).alias("score"))
