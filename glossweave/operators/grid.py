"""Cluster-size grids: aggregation, smoothing, gradients, the plateau solver, rankings and pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossweave.functions.keys import finite

COMBO = ["model", "layer"]
SIZE = "min_cluster_size"
PK = [*COMBO, "sample_idx", SIZE]


def std_or_zero(c: Column | str) -> Column:
    """Sample standard deviation; a single value has 0 (trap X3)."""
    return F.coalesce(F.stddev_samp(c), F.lit(0.0))


def aggregate_grid(grid: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean, standard deviation and count of dbcv and ari, mean icm and n_clusters, per size (A14, A15). NaN counts as missing."""
    keys = [*(by or []), SIZE]
    stats = []
    for m in ("dbcv", "ari"):
        c = finite(m)
        stats += [F.avg(c).alias(f"{m}_mean"), F.when(F.count(c) > 0, std_or_zero(c)).alias(f"{m}_std"), F.count(c).alias(f"{m}_count")]
    return grid.groupBy(*keys).agg(*stats, F.avg(finite("icm")).alias("icm_mean"), F.avg("n_clusters").alias("n_clusters_mean"))


def _over(by: list[str]) -> WindowSpec:
    return Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))


def smooth(df: DataFrame, y: str, x: str, window: int, by: list[str], weight: str | None = None, out: str = "y_smooth") -> DataFrame:
    """Centred moving average that shrinks at the edges; an even window is widened by one (W3), or weighted."""
    h = window // 2
    w = _over(by).orderBy(x).rowsBetween(-h, h)
    value = F.avg(y).over(w) if weight is None else F.try_divide(F.sum(F.col(weight) * F.col(y)).over(w), F.sum(weight).over(w))
    return df.withColumn(out, value)


def gradient(df: DataFrame, y: str, x: str, by: list[str], out: str) -> DataFrame:
    """First derivative on uneven spacing: second-order inside, one-sided at the ends, null for a single point."""
    w = _over(by).orderBy(x)
    before, after = F.col(x) - F.lag(x).over(w), F.lead(x).over(w) - F.col(x)
    y0, y1, y2 = F.lag(y).over(w), F.col(y), F.lead(y).over(w)
    inner = (before * before * y2 + (after * after - before * before) * y1 - after * after * y0) / (before * after * (before + after))
    return df.withColumn(out, F.when(before.isNotNull() & after.isNotNull(), inner).when(after.isNotNull(), (y2 - y1) / after).when(before.isNotNull(), (y1 - y0) / before))


def min_max(c: str, by: list[str], constant: float) -> Column:
    """(c - min) / (max - min) per group; ``constant`` for a constant group (W6: 1.0, W7: 0.5, trap X8)."""
    w = _over(by)
    lo, hi = F.min(c).over(w), F.max(c).over(w)
    return F.when(hi > lo, (F.col(c) - lo) / (hi - lo)).when(F.col(c).isNotNull(), F.lit(float(constant)))


def combine(a: str, b: str) -> tuple[Column, Column, Column]:
    """Mean, deviation and count of two measures ``a`` and ``b`` with ``_mean``, ``_std``, ``_count`` columns; one alone if the other is missing."""
    ma, mb, sa, sb = F.col(f"{a}_mean"), F.col(f"{b}_mean"), F.col(f"{a}_std"), F.col(f"{b}_std")
    both = ma.isNotNull() & mb.isNotNull()
    mean = F.when(both, (ma + mb) / 2).otherwise(F.coalesce(ma, mb))
    std = F.when(both, F.sqrt((sa * sa + sb * sb) / 4)).otherwise(F.coalesce(sa, sb))
    count = F.when(both, F.least(f"{a}_count", f"{b}_count")).when(ma.isNotNull(), F.col(f"{a}_count")).otherwise(F.col(f"{b}_count"))
    return mean, std, count


def objective(mean: Column, std: Column, count: Column, method: str = "mean", strength: float = 1.0) -> Column:
    """The curve to solve: the mean, or its lower bound."""
    if method not in ("mean", "lower_bound", "weighted"):
        raise ValueError(f"unknown method {method}")
    return mean - F.lit(strength) * F.coalesce(std, F.lit(0.0)) if method == "lower_bound" else mean


def precision_weight(std: Column, count: Column) -> Column:
    """count / (std^2 + 1e-8)."""
    return count / (std * std + F.lit(1e-8))


def cluster_reward(n_clusters: Column, reward: float, n_ref: int) -> Column:
    """reward * ln(max(clusters, 1) / n_ref)."""
    return F.lit(float(reward)) * F.ln(F.greatest(n_clusters, F.lit(1.0)) / F.lit(float(max(1, n_ref))))


def solve_sizes(
    aggregated: DataFrame, by: list[str], method: str = "mean", strength: float = 1.0, window: int = 3, tolerance: float = 0.12, plateau: float = 0.92, reward: float = 0.0, n_ref: int = 1
) -> DataFrame:
    """(by, chosen size, selection, score): the smallest size on the smoothed plateau, else the smoothed maximum.

    On the plateau the smoothed objective is at least min + ``plateau`` * range and its slope at most
    ``tolerance`` of the steepest. All combinations are solved in one plan.
    """
    mean, std, count = combine("dbcv", "ari")
    pts = aggregated.select(*by, F.col(SIZE).cast("double").alias("x"), mean.alias("score"), std.alias("sd"), count.cast("double").alias("n"), F.col("n_clusters_mean").cast("double").alias("k"))
    pts = pts.withColumn("y", objective(F.col("score"), F.col("sd"), F.col("n"), method, strength) + (cluster_reward(F.col("k"), reward, n_ref) if reward else F.lit(0.0))).where("y IS NOT NULL AND x IS NOT NULL")
    weighted = method in ("lower_bound", "weighted")
    pts = pts.withColumn("w", precision_weight(F.col("sd"), F.col("n"))) if weighted else pts
    pts = gradient(smooth(pts, "y", "x", window, by, "w" if weighted else None), "y_smooth", "x", by, "dy")
    w = _over(by)
    steepest = F.max(F.abs("dy")).over(w)
    pts = pts.select("*", F.min("y_smooth").over(w).alias("lo"), F.max("y_smooth").over(w).alias("hi"), F.when(steepest > 0, steepest).otherwise(1.0).alias("scale"))
    on = (F.col("y_smooth") >= F.col("lo") + plateau * (F.col("hi") - F.col("lo"))) & (F.abs("dy") <= tolerance * F.col("scale"))
    cols = F.struct("x", "score", "k")
    best = F.max(F.struct("y_smooth", (-F.col("x")).alias("nx"), cols.alias("p")))["p"]
    out = pts.groupBy(*by).agg(F.min(F.when(on, cols)).alias("flat"), best.alias("top")) if by else pts.agg(F.min(F.when(on, cols)).alias("flat"), best.alias("top"))
    p = F.coalesce("flat", "top")
    return out.select(*by, p["x"].cast("long").alias("chosen"), F.when(F.col("flat").isNotNull(), "plateau_derivative").otherwise("smoothed_argmax").alias("selection"), p["score"].alias("score"), p["k"].alias("n_clusters"))


def resolved_size(grid: DataFrame, by: list[str]) -> DataFrame:
    """(by, chosen): the most frequent chosen size, the smallest on ties (A22, trap X14)."""
    n = grid.where("chosen_min_cluster_size IS NOT NULL").groupBy(*by, "chosen_min_cluster_size").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*by).agg((-F.max(F.struct("n", (-F.col("chosen_min_cluster_size")).alias("s")))["s"]).cast("long").alias("chosen"))


def points_at_chosen(grid: DataFrame) -> DataFrame:
    """Per combination and sample the newest grid row at the chosen size with more than one cluster and an ari."""
    at = grid.join(resolved_size(grid, COMBO), COMBO).where((F.col(SIZE) == F.col("chosen")) & (F.col("n_clusters") > 1) & finite("ari").isNotNull())
    rank = F.row_number().over(Window.partitionBy(*COMBO, "sample_idx").orderBy(F.desc("ingested_at"), F.desc("ari")))
    return at.withColumn("r", rank).where("r = 1").drop("r")


def apply_chosen(grid: DataFrame, chosen: DataFrame) -> DataFrame:
    """The grid with ``chosen_min_cluster_size`` replaced where ``chosen`` has its combination."""
    return grid.join(chosen.select(*COMBO, "chosen"), COMBO, "left").withColumn("chosen_min_cluster_size", F.coalesce("chosen", "chosen_min_cluster_size")).drop("chosen")


def clusters_at(grid: DataFrame, size: int, by: list[str]) -> DataFrame:
    """n_clusters at one size per group; absent where the grid has no such point."""
    return grid.where(F.col(SIZE) == size).groupBy(*by).agg(F.max("n_clusters").alias("n_clusters"))


def summarise_search(grid: DataFrame, pooled: int) -> DataFrame:
    """Per combination the population mean and deviation of chosen sizes, scores at the pooled size and ari (A20, trap X3)."""
    at = F.when(F.col(SIZE) == pooled, finite("dbcv"))
    per = grid.groupBy(*COMBO, "sample_idx").agg(F.max("chosen_min_cluster_size").alias("size"), F.max(at).alias("score"), F.max(finite("dbcv")).alias("best"), F.avg(finite("ari")).alias("ari"))
    per = per.withColumn("score", F.coalesce("score", "best"))
    return per.groupBy(*COMBO).agg(*[f(c).alias(f"{c}_{n}") for c in ("size", "score", "ari") for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"))])


def pool_metrics(df: DataFrame, by: list[str], metrics: list[str], kind: str) -> DataFrame:
    """Mean and sample deviation of every metric, and the most frequent kind (first in order on ties) (A19, trap X14)."""
    stats = df.groupBy(*by).agg(*[f(m).alias(f"{m}_{n}") for m in metrics for f, n in ((F.avg, "mean"), (std_or_zero, "std"))])
    kinds = df.groupBy(*by, kind).agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), kind))
    return stats.join(kinds.withColumn("r", rank).where("r = 1").select(*by, kind), by)


def leaderboard(scores: DataFrame) -> DataFrame:
    """The best combination overall and per model by score; fusions (``+`` in the model) don't compete (A23, trap X29)."""
    single = scores.where(~F.col("model").contains("+"))
    w = Window.partitionBy("model").orderBy(F.desc("score"), "layer")
    per = single.withColumn("r", F.row_number().over(w)).where("r = 1")
    return per.select("model", "layer", "score", (F.row_number().over(Window.orderBy(F.desc("score"), "model")) == 1).alias("overall"))


def ranked_entries(df: DataFrame, metric: str, n: int, order: list[str]) -> DataFrame:
    """The ``n`` largest of a metric that is not null, ranked."""
    top = df.where(F.col(metric).isNotNull()).orderBy(F.desc(metric), *order).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(metric), *order)).cast("long"))


def fusion_candidates(scores: DataFrame, order: int, k: int) -> DataFrame:
    """The ``k`` sets of ``order`` (2 or 3) distinct combinations with the largest summed score.

    Only the best k + order - 1 single combinations can take part in a set of the best k, so the
    self-join runs over that many rows.
    """
    if order not in (2, 3):
        raise ValueError("order must be 2 or 3")
    first = scores.where("score IS NOT NULL").orderBy(F.desc("score"), *COMBO).limit(k + order - 1)
    item = first.select(F.row_number().over(Window.orderBy(F.desc("score"), *COMBO)).alias("i"), F.concat_ws("/", *COMBO).alias("name"), "score")
    sets = item.select(F.col("i").alias("i1"), F.col("name").alias("n1"), F.col("score").alias("s"))
    for j in range(2, order + 1):
        nxt = item.select(F.col("i").alias(f"i{j}"), F.col("name").alias(f"n{j}"), F.col("score").alias("t"))
        sets = sets.join(F.broadcast(nxt), F.col(f"i{j}") > F.col(f"i{j - 1}")).withColumn("s", F.col("s") + F.col("t")).drop("t")
    names = F.array_join(F.array_sort(F.array(*[F.col(f"n{j}") for j in range(1, order + 1)])), "+")
    return sets.orderBy(F.round("s", 9).desc(), *[f"i{j}" for j in range(1, order + 1)]).limit(k).select(names.alias("members"), F.col("s").alias("score"))


def pivot_metric(df: DataFrame, metric: str, layers: list[str]) -> DataFrame:
    """model x layer matrix of a metric."""
    return df.groupBy("model").pivot("layer", layers).agg(F.first(metric))


def scale_to_band(df: DataFrame, weight: str, ends: list[str], least: float) -> DataFrame:
    """Weights scaled up so that the smallest node total reaches ``least``."""
    totals = None
    for e in ends:
        t = df.groupBy(F.col(e).alias("node")).agg(F.sum(weight).alias("total"))
        totals = t if totals is None else totals.unionByName(t)
    smallest = totals.where("total > 0").agg(F.min("total")).first()[0]
    return df.withColumn(weight, F.col(weight) * F.lit(max(1.0, least / smallest) if smallest else 1.0))
