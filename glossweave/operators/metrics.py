"""Evaluation: agreement, rank statistics, curves, quantiles, ellipses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossweave.functions.vectors import l2_normalise
from glossweave.operators.skew import heavy_light_lookup, key_profile, order_bin, quantile_name


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row ``ari`` from the contingency table; 0 where it is not defined (A16). Rows with a null are left out."""
    pairs = lambda c: (F.col(c) * (F.col(c) - 1) / 2).cast("double")
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    side = lambda k: cells.groupBy(k).agg(F.sum("n").alias("n")).agg(F.sum(pairs("n")).alias("s"))
    s = cells.agg(F.sum(pairs("n")).alias("ij"), F.sum("n").alias("n"))
    joined = s.join(side(a).withColumnRenamed("s", "i"), F.lit(True)).join(side(b).withColumnRenamed("s", "j"), F.lit(True))
    expected = F.try_divide(F.col("i") * F.col("j"), pairs("n"))
    return joined.select(F.coalesce(F.try_divide(F.col("ij") - expected, (F.col("i") + F.col("j")) / 2 - expected), F.lit(0.0)).alias("ari"))


def cosine_spread(df: DataFrame, group: str, vector: str, dim: int) -> DataFrame:
    """(group, n, mean_cosine): exact mean pairwise cosine per group from the sum of unit vectors, without pairs (A18's mean term)."""
    unit = df.select(group, F.posexplode(l2_normalise(vector)).alias("pos", "val"))
    sums = unit.groupBy(group, "pos").agg(F.sum("val").alias("s"), F.count(F.lit(1)).alias("n"))
    total = sums.groupBy(group).agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.max("n").alias("n"))
    return total.select(group, "n", F.try_divide(F.col("ss") - F.col("n"), F.col("n") * (F.col("n") - 1)).alias("mean_cosine"))


#: Rows of a group that one task takes in.
_GROUP_ROWS = 20_000


def cosine_deviation(df: DataFrame, group: str, vector: str, row_id: str, dim: int) -> DataFrame:
    """(group, n_pairs, std): exact sample deviation of the cosines of all pairs of a group.

    With unit rows u, the cosines of all pairs sum to (|sum u|^2 - n) / 2 and their squares to
    (|sum u u'|^2 - n) / 2, so no pair is formed and no cap is needed. Groups of more than
    ``_GROUP_ROWS`` rows are split over tasks by a hash of the row id and their moments are added.
    Vectors must be usable; a group of one row has no row in the result, one of two a null deviation.
    """
    import numpy as np
    import pyarrow as pa

    from glossweave.functions.vectors import unit_rows

    kind = df.schema[group].dataType.simpleString()
    counts = df.groupBy(F.col(group).alias("g")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("parts", F.ceil(F.col("n") / _GROUP_ROWS).cast("int"))
    rows = df.select(F.col(group).alias("g"), F.col(vector).alias("v"), F.xxhash64(row_id).alias("h"))
    rows = heavy_light_lookup(rows, counts, "g", "inner")
    rows = rows.select("g", "v", "parts", F.pmod("h", F.col("parts")).cast("int").alias("part"))

    def moments(key: tuple, t: pa.Table) -> pa.Table:
        u = unit_rows(t.column("v").combine_chunks(), dim)[1]
        single = t.column("parts")[0].as_py() == 1
        m = u.T @ u if len(u) >= dim or not single else u @ u.T
        s1, s2 = (float((u.sum(axis=0) ** 2).sum()), float((m * m).sum())) if single else (None, None)
        blob = None if single else np.concatenate([u.sum(axis=0), m.ravel()]).tobytes()
        return pa.table({"g": pa.array([key[0].as_py()], key[0].type), "n": pa.array([len(u)], pa.int64()), "s1": pa.array([s1], pa.float64()), "s2": pa.array([s2], pa.float64()), "blob": pa.array([blob], pa.binary())})

    def added(key: tuple, t: pa.Table) -> pa.Table:
        n = sum(t.column("n").to_pylist())
        x = sum(np.frombuffer(v.as_py(), dtype=np.float64) for v in t.column("blob"))
        return pa.table({"g": pa.array([key[0].as_py()], key[0].type), "n": pa.array([n], pa.int64()), "s1": [float((x[:dim] ** 2).sum())], "s2": [float((x[dim:] ** 2).sum())]})

    parts = rows.groupBy("g", "part").applyInArrow(moments, f"g {kind}, n long, s1 double, s2 double, blob binary")
    whole = parts.where("blob IS NULL").select("g", "n", "s1", "s2").unionByName(
        parts.where("blob IS NOT NULL").groupBy("g").applyInArrow(added, f"g {kind}, n long, s1 double, s2 double")
    )
    n, pairs = F.col("n").cast("double"), F.col("n") * (F.col("n") - 1) / 2
    c1, c2 = (F.col("s1") - n) / 2, (F.col("s2") - n) / 2
    var = F.try_divide(c2 - c1 * c1 / pairs, pairs - 1)
    return whole.select(F.col("g").alias(group), pairs.cast("long").alias("n_pairs"), F.when(pairs > 1, F.sqrt(F.greatest(var, F.lit(0.0)))).alias("std"))


def sums_below(df: DataFrame, value: str, columns: list[str]) -> DataFrame:
    """The frame with ``below_<column>``: the column's sum over all rows of a smaller value. Values must be distinct.

    Order-preserving bins (some ten thousand at most) are summed and cumulated first; only inside a bin are
    rows ordered, each bin in its own window, so no task holds all values.
    """
    binned = df.withColumn("__bin", order_bin(F.col(value).cast("double")))
    totals = binned.groupBy("__bin").agg(*[F.sum(c).alias(f"__t_{c}") for c in columns])
    before = Window.orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("__bin", *[F.coalesce(F.sum(f"__t_{c}").over(before), F.lit(0)).alias(f"__t_{c}") for c in columns])
    inside = Window.partitionBy("__bin").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    rows = binned.join(totals, "__bin")
    sums = {f"below_{c}": F.col(f"__t_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in columns}
    return rows.withColumns(sums).drop("__bin", *[f"__t_{c}" for c in columns])


def auc(df: DataFrame, y: str, score: str) -> DataFrame:
    """One row ``auc`` by average ranks, 0.5 with one class only (W18). Scores are grouped before they are ranked."""
    by = df.where(F.col(score).isNotNull() & F.col(y).isNotNull()).groupBy(score).agg(F.sum(y).alias("pos"), F.count(F.lit(1)).alias("n"))
    ranked = sums_below(by, score, ["n"]).withColumn("rank", F.col("below_n") + (F.col("n") + 1) / 2)
    s = ranked.agg(F.sum(F.col("rank") * F.col("pos")).alias("r"), F.sum("pos").cast("double").alias("p"), F.sum("n").cast("double").alias("n"))
    return s.select(F.coalesce(F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * (F.col("n") - F.col("p"))), F.lit(0.5)).alias("auc"))


def curve(df: DataFrame, y: str, score: str) -> DataFrame:
    """(threshold, pos, tp, fp, tpr, fpr, precision, recall, f1) for every score, ties together (W17); ``pos`` are the positives at the score."""
    by = df.where(F.col(score).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(score).alias("threshold")).agg(F.sum(y).cast("long").alias("pos"), F.count(F.lit(1)).alias("n"))
    by = by.withColumn("neg", F.col("n") - F.col("pos"))
    totals = by.agg(F.sum("pos").alias("np"), F.sum("neg").alias("nn"))
    c = sums_below(by, "threshold", ["pos", "neg"]).join(F.broadcast(totals), F.lit(True))
    c = c.withColumns({"tp": F.col("np") - F.col("below_pos"), "fp": F.col("nn") - F.col("below_neg")})
    tp, fp = F.col("tp").cast("double"), F.col("fp").cast("double")
    return c.select(
        "threshold", "pos", "tp", "fp", F.try_divide(tp, "np").alias("tpr"), F.try_divide(fp, "nn").alias("fpr"),
        F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, "np").alias("recall"), F.try_divide(2 * tp, tp + fp + F.col("np")).alias("f1"),
    )


def average_precision(points: DataFrame) -> DataFrame:
    """One row: the step-wise area below a precision-recall curve (W17); a step's width is its share of the positives."""
    return points.agg(F.try_divide(F.sum(F.col("pos") * F.col("precision")), F.sum("pos")).alias("average_precision"))


def best_f1(points: DataFrame) -> DataFrame:
    """The threshold of the best F1, the lowest one on ties."""
    return points.orderBy(F.round("f1", 9).desc(), "threshold").limit(1).select("threshold", "f1")


def binary_metrics(df: DataFrame, y: str, score: str, by: list[str], threshold: float = 0.0) -> DataFrame:
    """Precision, recall and F1 at score > threshold, 0 where undefined (E12, trap X27)."""
    said, true = F.col(score) > threshold, F.col(y) == 1
    n = lambda c: F.count(F.when(c, 1)).cast("double")
    tp, fp, fn = n(said & true), n(said & ~true), n(~said & true)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    aggs = [zero(F.try_divide(tp, tp + fp)).alias("precision"), zero(F.try_divide(tp, tp + fn)).alias("recall"), zero(F.try_divide(2 * tp, 2 * tp + fp + fn)).alias("f1")]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def quantile_table(df: DataFrame, columns: list[str], qs: list[float]) -> DataFrame:
    """(metric, q, value): exact interpolated quantiles over all rows.

    Through value frequencies and order-preserving bins, as no aggregation buffer may hold all values.
    """
    one = key_profile(df.withColumn("__all", F.lit(0)), "__all", {c: F.col(c) for c in columns}, {}, qs)
    rows = [F.struct(F.lit(c).alias("metric"), F.lit(q).alias("q"), F.col(quantile_name(q, c)).alias("value")) for c in columns for q in qs]
    return one.select(F.inline(F.array(*rows)))


def z_scores(df: DataFrame, columns: list[str], batch: list[str]) -> DataFrame:
    """The frame with ``z_<column>``: population z-scores within a batch, 0 where it doesn't vary (W8, trap X23), and their maximum.

    Batch moments are aggregated and joined, so that no window holds a batch.
    """
    m = df.groupBy(*batch).agg(*[f(c).alias(f"__{n}_{c}") for c in columns for f, n in ((F.avg, "m"), (F.stddev_pop, "s"))])
    j = df.join(m, batch)
    z = {f"z_{c}": F.when(F.col(f"__s_{c}") > 1e-12, (F.col(c) - F.col(f"__m_{c}")) / F.col(f"__s_{c}")).otherwise(F.when(F.col(c).isNotNull(), 0.0)) for c in columns}
    return j.withColumns(z).drop(*[f"__{n}_{c}" for c in columns for n in "ms"]).withColumn("max_z", F.greatest(*[f"z_{c}" for c in columns]))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row ``rho``: correlation of average ranks (A26). Ranks come from the grouped values."""

    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())

    def ranks(c: str) -> DataFrame:
        g = both.groupBy(c).agg(F.count(F.lit(1)).alias("n"))
        return sums_below(g, c, ["n"]).select(c, (F.col("below_n") + (F.col("n") + 1) / 2).alias(f"__r_{c}"))

    n = both.count()
    ranked = heavy_light_lookup(heavy_light_lookup(both, ranks(x), x, "inner", n), ranks(y), y, "inner", n)
    return ranked.agg(F.corr(f"__r_{x}", f"__r_{y}").alias("rho"))


def ellipse(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Centre, covariance and 95 % half-axes of two measures per group; null below two points."""
    g = df.groupBy(*by).agg(F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_samp(x).alias("vx"), F.var_samp(y).alias("vy"), F.covar_samp(x, y).alias("c"))
    mid, half = (F.col("vx") + F.col("vy")) / 2, F.sqrt(F.pow((F.col("vx") - F.col("vy")) / 2, F.lit(2)) + F.col("c") * F.col("c"))
    chi = F.lit(5.991464547107979)  # 95 % point of chi-square with two degrees of freedom
    axis = lambda v: F.sqrt(chi * F.greatest(v, F.lit(0.0)))
    return g.select(*by, "mx", "my", F.col("c").alias("covariance"), axis(mid + half).alias("major"), axis(mid - half).alias("minor"))


def boundary(x0: float, y0: float, x1: float, y1: float) -> tuple[float, float]:
    """Slope and intercept of the line through two points (P20)."""
    k = (y1 - y0) / (x1 - x0)
    return k, y0 - k * x0


def signed_distance(r: Column, m: Column, k: float, b: Column | float) -> Column:
    """k * r + b - m (P20)."""
    return F.lit(k) * r + (b if isinstance(b, Column) else F.lit(b)) - m


def operating_points(df: DataFrame, y: str, r: str, m: str, k: float, b: float, n: int = 120) -> DataFrame:
    """Precision, recall and F1 of the boundary moved through ``n`` intercepts from b - 10 to b + 6.

    Each row is counted at the first intercept that accepts it; cumulated counts give all operating points
    without comparing every row with every intercept.
    """
    step = 16.0 / (n - 1)
    need = (F.col(m) - F.lit(k) * F.col(r) - F.lit(b - 10)) / F.lit(step)  # accepted where the intercept is larger
    at = F.greatest(F.lit(0), F.floor(need) + 1).cast("int")
    counts = df.where(F.col(m).isNotNull() & F.col(r).isNotNull() & F.col(y).isNotNull()).groupBy(F.least(at, F.lit(n)).alias("i")).agg(F.sum(y).cast("long").alias("p"), F.count(F.lit(1)).alias("n"))
    all_i = df.sparkSession.range(n + 1).select(F.col("id").cast("int").alias("i")).join(counts, "i", "left").fillna(0, ["p", "n"])
    w = Window.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    c = all_i.select("i", F.sum("p").over(w).cast("double").alias("tp"), F.sum("n").over(w).cast("double").alias("said"), F.sum("p").over(Window.partitionBy(F.lit(0))).alias("np"))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return c.where(F.col("i") < n).select(
        F.col("i").cast("long").alias("point"), (F.lit(b - 10) + F.col("i") * step).alias("intercept"),
        zero(F.try_divide("tp", "said")).alias("precision"), zero(F.try_divide("tp", "np")).alias("recall"), zero(F.try_divide(2 * F.col("tp"), F.col("said") + F.col("np"))).alias("f1"),
    )
