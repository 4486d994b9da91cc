"""Estimators: screeners with cross-validation, density clustering, size grids."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossweave.operators.frames import folds
from glossweave.operators.metrics import binary_metrics
from glossweave.operators.vectors import sum_batches

#: Rows that density clustering takes into one task; more are refused, take a sample.
MAX_CLUSTER_ROWS = 20_000


def _design(b: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    return x, b.column(1).to_numpy(zero_copy_only=False).astype(np.float64)


@dataclass(frozen=True)
class LinearScreener:
    """score = features(x) . w + b; higher is more like the negative class, a row is screened above 0."""

    weights: np.ndarray
    bias: float
    kind: str
    omega: np.ndarray | None = field(default=None)
    phase: np.ndarray | None = field(default=None)

    def features(self, x: np.ndarray) -> np.ndarray:
        """The rows themselves, or their random Fourier features."""
        return x if self.omega is None else np.cos(x @ self.omega + self.phase) * np.sqrt(2 / len(self.phase))

    def values(self, x: np.ndarray) -> np.ndarray:
        """The decision value of every row."""
        return self.features(x) @ self.weights + self.bias

    def score(self, df: DataFrame, vector: str, out: str = "score") -> DataFrame:
        """The frame with the decision value; null for a null vector."""
        model, d = self, len(self.weights) if self.omega is None else len(self.omega)

        def run(v: pa.Array) -> pa.Array:
            ok = v.is_valid()
            x = v.filter(ok).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            s = np.full(len(v), np.nan)
            s[ok.to_numpy(zero_copy_only=False)] = model.values(x)
            return pa.array(s, pa.float64(), mask=np.isnan(s))

        return df.withColumn(out, F.arrow_udf(run, "double")(F.col(vector)))


def _trivial(dim: int, kind: str) -> LinearScreener:
    return LinearScreener(np.zeros(dim), 0.0, kind)


def fit_lda(df: DataFrame, vector: str, y: str, dim: int, ridge: float = 1e-6) -> LinearScreener:
    """Fisher's discriminant from class means and pooled covariance over all rows (E7). One class alone screens nothing."""

    def moments(b: pa.RecordBatch) -> np.ndarray:
        x, t = _design(b, dim)
        return np.concatenate([np.concatenate([[(t == c).sum()], x[t == c].sum(axis=0), (x[t == c].T @ x[t == c]).ravel()]) for c in (0, 1)])

    m = sum_batches(df.where(F.col(vector).isNotNull() & F.col(y).isNotNull()).select(vector, y), moments)
    if m is None:
        raise ValueError("no rows to fit")
    (n0, s0, q0), (n1, s1, q1) = ((p[0], p[1 : 1 + dim], p[1 + dim :].reshape(dim, dim)) for p in np.split(m, 2))
    if not n0 or not n1:
        return _trivial(dim, "lda")
    m0, m1 = s0 / n0, s1 / n1
    pooled = (q0 - n0 * np.outer(m0, m0) + q1 - n1 * np.outer(m1, m1)) / max(1.0, n0 + n1 - 2)
    w = np.linalg.lstsq(pooled + ridge * np.trace(pooled) / dim * np.eye(dim), m1 - m0, rcond=None)[0]
    return LinearScreener(w, float(-w @ (m0 + m1) / 2 + np.log(n1 / n0)), "lda")


def fit_svm(df: DataFrame, vector: str, y: str, dim: int, c: float = 1.0, rounds: int = 12, rbf: int = 0, gamma: float | None = None, seed: int = 0) -> LinearScreener:
    """Squared-hinge linear machine by Newton steps, each one pass over all rows (E7, E8); ``rbf`` random Fourier features for a radial kernel."""
    rng = np.random.default_rng(seed)
    omega = rng.normal(size=(dim, rbf)) * np.sqrt(2 * (gamma or 1 / dim)) if rbf else None
    phase = rng.uniform(0, 2 * np.pi, rbf) if rbf else None
    d = rbf or dim
    model = LinearScreener(np.zeros(d), 0.0, "rbf" if rbf else "svm", omega, phase)
    source = df.where(F.col(vector).isNotNull() & F.col(y).isNotNull()).select(vector, y)
    for _ in range(rounds):

        def step(b: pa.RecordBatch, model: LinearScreener = model) -> np.ndarray:
            x, t = _design(b, dim)
            z = np.hstack([model.features(x), np.ones((len(x), 1))])
            s = 2 * t - 1
            slack = 1 - s * (z @ np.append(model.weights, model.bias))
            on = slack > 0
            g = -2 * c * (z[on] * (s[on] * slack[on])[:, None]).sum(axis=0)
            return np.concatenate([[len(x), t.sum()], g, (2 * c * z[on].T @ z[on]).ravel()])

        m = sum_batches(source, step)
        if m is None:
            raise ValueError("no rows to fit")
        if m[1] in (0, m[0]):
            return _trivial(dim, model.kind)
        penalty = np.append(np.ones(d), 1e-9)
        theta = np.append(model.weights, model.bias)
        g, h = m[2 : 3 + d] + penalty * theta, m[3 + d :].reshape(d + 1, d + 1) + np.diag(penalty)
        move = np.linalg.solve(h, g)
        theta = theta - move
        model = LinearScreener(theta[:-1], float(theta[-1]), model.kind, omega, phase)
        if np.abs(move).max() < 1e-6:
            break
    return model


def cross_validated_scores(df: DataFrame, vector: str, y: str, dim: int, k: int = 5, seed: int = 0, row_id: str = "row_id") -> DataFrame:
    """(row_id, y, fold, lda, svm): every row scored by models that did not see its fold."""
    split = folds(df.where(F.col(vector).isNotNull() & F.col(y).isNotNull()), y, k, seed, row_id).select(row_id, y, "fold", vector)
    out = None
    for i in range(k):
        train, test = split.where(F.col("fold") != i), split.where(F.col("fold") == i)
        part = fit_svm(train, vector, y, dim).score(fit_lda(train, vector, y, dim).score(test, vector, "lda"), vector, "svm").drop(vector)
        out = part if out is None else out.unionByName(part)
    return out


def screener_report(scores: DataFrame, y: str) -> DataFrame:
    """(kind, precision/recall/f1 mean and deviation over folds) (E9, E10, E12); the winner has the best mean F1, ties prefer lda."""
    out = None
    for kind in ("lda", "svm"):
        per = binary_metrics(scores, y, kind, ["fold"])
        one = per.agg(*[f(m).alias(f"{m}_{n}") for m in ("precision", "recall", "f1") for f, n in ((F.avg, "mean"), (F.stddev_samp, "std"))]).withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("winner", F.col("kind") == out.orderBy(F.desc("f1_mean"), "kind").first()["kind"])


def _mst(x: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Core distances and the edges (a, b, distance) of the mutual-reachability spanning tree, by Prim's method."""
    n = len(x)
    sq = (x * x).sum(axis=1)
    k = min(least, n - 1)
    core = np.empty(n)
    for i in range(0, n, 1024):
        d = np.sqrt(np.maximum(sq[i : i + 1024, None] + sq[None, :] - 2 * x[i : i + 1024] @ x.T, 0))
        core[i : i + 1024] = np.partition(d, k, axis=1)[:, k]
    best, link, done, at = np.full(n, np.inf), np.zeros(n, int), np.zeros(n, bool), 0
    edges = np.empty((n - 1, 3))
    for e in range(n - 1):
        done[at] = True
        d = np.maximum(np.maximum(np.sqrt(np.maximum(sq + sq[at] - 2 * x @ x[at], 0)), core), core[at])
        closer = ~done & (d < best)
        best[closer], link[closer] = d[closer], at
        nxt = int(np.argmin(np.where(done, np.inf, best)))
        edges[e] = link[nxt], nxt, best[nxt]
        at = nxt
    return core, edges[np.argsort(edges[:, 2], kind="stable")]


def density_clusters(x: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Labels (-1 for noise), membership in [0, 1] and validity of a hierarchical density clustering.

    Single linkage on mutual reachability; splits that leave fewer than ``least`` points fall out of their
    cluster; the clusters of greatest stability are selected, never the root. The validity weighs each
    cluster's (separation - sparseness) / max of both by its share of points.
    """
    n = len(x)
    labels, member = np.full(n, -1), np.zeros(n)
    if n < max(2, least):
        return labels, member, float("nan")
    _, edges = _mst(x, least)
    parent, size = list(range(2 * n - 1)), [1] * n + [0] * (n - 1)
    kids: list[tuple[int, int]] = []
    dist = np.zeros(2 * n - 1)

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for e, (a, b, d) in enumerate(edges):
        ra, rb = find(int(a)), find(int(b))
        kids.append((ra, rb))
        parent[ra] = parent[rb] = n + e
        size[n + e], dist[n + e] = size[ra] + size[rb], d

    def leaves(i: int) -> list[int]:
        out, todo = [], [i]
        while todo:
            j = todo.pop()
            if j < n:
                out.append(j)
            else:
                todo += kids[j - n]
        return out

    # condensed tree: (birth, stability, children, points)
    birth, stability, child, points, todo = [0.0], [0.0], [[]], [[]], [(2 * n - 2, 0)]
    while todo:
        node, c = todo.pop()
        while node >= n:
            a, b = kids[node - n]
            lam = 1 / max(dist[node], 1e-12)
            big = [k for k in (a, b) if size[k] >= least]
            if len(big) == 2:
                stability[c] += (lam - birth[c]) * size[node]
                for k in (a, b):
                    birth.append(lam)
                    stability.append(0.0)
                    child.append([])
                    points.append([])
                    child[c].append(len(birth) - 1)
                    todo.append((k, len(birth) - 1))
                break
            for k in (a, b):
                if k not in big:
                    out = leaves(k)
                    stability[c] += (lam - birth[c]) * len(out)
                    points[c] += [(p, lam) for p in out]
            if not big:
                break
            node = big[0]
        else:
            points[c].append((node, birth[c]))
    chosen, worth = set(), list(stability)
    for c in range(len(birth) - 1, 0, -1):
        below = sum(worth[k] for k in child[c])
        if stability[c] >= below:
            stack = list(child[c])
            while stack:
                k = stack.pop()
                chosen.discard(k)
                stack += child[k]
            chosen.add(c)
        else:
            worth[c] = below
    for i, c in enumerate(sorted(chosen)):
        stack, got = [c], []
        while stack:
            k = stack.pop()
            got += points[k]
            stack += child[k]
        top = max(lam for _, lam in got)
        for p, lam in got:
            labels[p], member[p] = i, min(1.0, lam / top)
    return labels, member, _validity(edges, labels)


def _validity(edges: np.ndarray, labels: np.ndarray) -> float:
    k = labels.max() + 1
    if k < 2:
        return float("nan")
    la, lb, d = labels[edges[:, 0].astype(int)], labels[edges[:, 1].astype(int)], edges[:, 2]
    total = 0.0
    for c in range(k):
        inside, out = (la == c) & (lb == c), (la == c) ^ (lb == c)
        sparse, apart = d[inside].max(initial=0.0), d[out].min(initial=np.inf)
        if np.isfinite(apart) and max(sparse, apart) > 0:
            total += (labels == c).sum() / len(labels) * (apart - sparse) / max(sparse, apart)
    return float(total)


def size_grid(df: DataFrame, row_id: str, coords: str, entity: str, sizes: list[int]) -> DataFrame:
    """(min_cluster_size, icm, n_clusters, dbcv, ari): one task per size over a bounded frame (E2, trap X26).

    The frame is broadcast to the tasks and refused beyond ``MAX_CLUSTER_ROWS`` rows. Sizes without a
    cluster are absent. icm is the mean over clusters of the deviation of pairwise cosines.
    """
    rows = df.where(F.col(coords).isNotNull()).select(row_id, coords, entity).limit(MAX_CLUSTER_ROWS + 1).collect()
    if len(rows) > MAX_CLUSTER_ROWS:
        raise ValueError(f"more than {MAX_CLUSTER_ROWS} rows; take a sample")
    rows.sort(key=lambda r: r[0])
    shared = df.sparkSession.sparkContext.broadcast((np.array([r[1] for r in rows]), [r[2] for r in rows]))

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x, names = shared.value
        labels, _, dbcv = density_clusters(x, int(key[0]))
        k = labels.max() + 1
        if k < 1:
            return pd.DataFrame([], columns=["min_cluster_size", "icm", "n_clusters", "dbcv", "ari"])
        spread = []
        for c in range(k):
            u = x[labels == c] / np.maximum(np.linalg.norm(x[labels == c], axis=1, keepdims=True), 1e-12)
            cos = (u @ u.T)[np.triu_indices(len(u), 1)]
            spread.append(cos.std(ddof=1) if len(cos) > 1 else np.nan)
        on = [i for i in range(len(x)) if labels[i] >= 0 and names[i] is not None]
        t = pd.crosstab(pd.Series([names[i] for i in on]), labels[on]).to_numpy(float) if on else np.zeros((0, 0))
        pairs = lambda v: (v * (v - 1) / 2).sum()
        i, a, b, n = pairs(t), pairs(t.sum(axis=1)), pairs(t.sum(axis=0)), pairs(np.array([t.sum()]))
        top = (a + b) / 2 - (a * b / n if n else 0)
        return pd.DataFrame([(int(key[0]), float(np.nanmean(spread)), int(k), dbcv, (i - a * b / n) / top if n and top else 0.0)], columns=["min_cluster_size", "icm", "n_clusters", "dbcv", "ari"])

    todo = df.sparkSession.createDataFrame([(s,) for s in sizes], "min_cluster_size int").repartition(len(sizes), "min_cluster_size")
    return todo.groupBy("min_cluster_size").applyInPandas(one, "min_cluster_size int, icm double, n_clusters int, dbcv double, ari double")


def cluster_sample(df: DataFrame, row_id: str, coords: str, least: int) -> DataFrame:
    """(row_id, cluster, probability) of a bounded frame by density clustering."""
    id_type = df.schema[row_id].dataType.simpleString()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > MAX_CLUSTER_ROWS:
            raise ValueError(f"more than {MAX_CLUSTER_ROWS} rows; take a sample")
        pdf = pdf.sort_values("id")
        labels, member, _ = density_clusters(np.stack(pdf["x"].to_numpy()), least)
        return pd.DataFrame({row_id: pdf["id"], "cluster": labels, "probability": member})

    rows = df.where(F.col(coords).isNotNull()).select(F.col(row_id).alias("id"), F.col(coords).alias("x")).limit(MAX_CLUSTER_ROWS + 1)
    return rows.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(one, f"{row_id} {id_type}, cluster int, probability double")


def nearest_fitted(df: DataFrame, fitted: DataFrame, row_id: str, coords: str) -> DataFrame:
    """(row_id, cluster, is_fitted) for every row with coordinates: the label of the nearest fitted row.

    ``fitted`` (row_id, coords, cluster) is the bounded frame that was clustered; its rows keep their labels, and
    noise is the label of what is nearest to noise. It is sent to the tasks, and refused beyond
    ``MAX_CLUSTER_ROWS`` rows.
    """
    rows = fitted.select(row_id, coords, "cluster").limit(MAX_CLUSTER_ROWS + 1).collect()
    if len(rows) > MAX_CLUSTER_ROWS:
        raise ValueError(f"more than {MAX_CLUSTER_ROWS} fitted rows")
    rows.sort(key=lambda r: r[0])
    x, labels = np.array([r[1] for r in rows], dtype=np.float64), np.array([r[2] for r in rows], dtype=np.int32)
    ids = np.array([r[0] for r in rows], dtype=np.int64)

    def nearest(v: pa.Array, key: pa.Array) -> pa.Array:
        y = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1) if len(v) else np.zeros((0, 1))
        out = np.full(len(y), -1, np.int32)
        known = np.isin(key.to_numpy(zero_copy_only=False), ids)
        for i in range(0, len(y) if len(x) else 0, 1024):
            d = (x * x).sum(axis=1)[None, :] - 2 * y[i : i + 1024] @ x.T
            out[i : i + 1024] = labels[d.argmin(axis=1)]
        if known.any():
            out[known] = labels[np.searchsorted(ids, key.to_numpy(zero_copy_only=False)[known])]
        return pa.StructArray.from_arrays([pa.array(out), pa.array(known)], ["cluster", "is_fitted"])

    placed = df.where(F.col(coords).isNotNull()).select(row_id, F.arrow_udf(nearest, "struct<cluster:int,is_fitted:boolean>")(coords, F.col(row_id).cast("long")).alias("__n"))
    return placed.select(row_id, "__n.cluster", "__n.is_fitted")


def whole_size_grid(df: DataFrame, sample: DataFrame, row_id: str, coords: str, entity: str, sizes: list[int], dim: int) -> DataFrame:
    """(min_cluster_size, icm, n_clusters, dbcv, ari) of all rows.

    For every size the bounded ``sample`` is clustered and all rows of ``df`` get the label of the nearest sampled
    row; agreement with the entities, the number of clusters and the mean deviation of pairwise cosines are over
    all rows, the validity is that of the fit.
    """
    from glossweave.operators.metrics import adjusted_rand, cosine_deviation
    from glossweave.tables import materialise

    fit = {r["min_cluster_size"]: r["dbcv"] for r in size_grid(sample, row_id, coords, entity, sizes).collect()}
    out = None
    for size in sorted(fit):
        labels = cluster_sample(sample, row_id, coords, size).join(sample.select(row_id, coords), row_id)
        rows = nearest_fitted(df, labels, row_id, coords).where("cluster >= 0").join(df.select(row_id, coords, entity), row_id)
        rows = materialise(rows, "labelled")
        icm = cosine_deviation(rows, "cluster", coords, row_id, dim).agg(F.avg("std").alias("icm"))
        n = rows.agg(F.count_distinct("cluster").cast("int").alias("n_clusters"))
        one = icm.crossJoin(n).crossJoin(adjusted_rand(rows, entity, "cluster"))  # one row each
        one = one.select(F.lit(size).alias("min_cluster_size"), "icm", "n_clusters", F.lit(fit[size]).alias("dbcv"), "ari")
        out = one if out is None else out.unionByName(one)
    schema = "min_cluster_size int, icm double, n_clusters int, dbcv double, ari double"
    return df.sparkSession.createDataFrame([], schema) if out is None else out
