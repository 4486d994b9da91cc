"""Per-key results and lookups that stay balanced when few keys hold most rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossweave.tables import materialise

#: A key is heavy when it holds at least 1/HEAVY_PARTS of the rows, so there are at most that many.
HEAVY_PARTS = 256
_STEPS = 1024


#: Below so many rows even a single key's share fits one task; the plan is the ordinary join then, with the same rows.
LIGHT_ROWS = 100_000


def heavy_light_lookup(facts: DataFrame, lookup: DataFrame, key: str, how: str = "left", total: int | None = None) -> DataFrame:
    """Join ``facts`` to a lookup that is unique in ``key`` without sending a hot key to one task.

    At most ``HEAVY_PARTS`` keys can hold 1/HEAVY_PARTS of the rows each; their lookup rows are
    broadcast, which that number bounds, and every other key goes through an ordinary join.
    ``total`` is the number of rows of ``facts`` where the caller knows it. Null keys match nothing and are
    kept by ``how='left'``.
    """
    if how not in ("left", "inner"):
        raise ValueError(how)
    counts = facts.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    total = facts.count() if total is None else total
    heavy = [r[0] for r in counts.where(F.col("__n") * HEAVY_PARTS >= total).limit(HEAVY_PARTS + 1).select(key).collect()] if total > LIGHT_ROWS else []
    if not heavy:
        return facts.join(lookup, key, how)
    is_heavy = F.coalesce(F.col(key).isin(heavy), F.lit(False))
    light = facts.where(~is_heavy).join(lookup.where(~F.col(key).isin(heavy)), key, how)
    return light.unionByName(facts.where(is_heavy).join(F.broadcast(lookup.where(F.col(key).isin(heavy))), key, how))


def order_bin(v: Column) -> Column:
    """An integer that never falls as ``v`` rises: 32 bins in each power of two, 0 for zero."""
    mag = F.floor(F.log2(F.abs(v)) * 32).cast("int")
    return F.when(v > 0, mag + 100_000).when(v < 0, -mag - 100_000).otherwise(F.lit(0)).cast("int")


def quantile_name(p: float, name: str) -> str:
    """Column of a quantile: q and its percentage, with _ for the decimal point."""
    percent = f"{round(p * 100, 6):g}".replace(".", "_")
    return f"q{percent.zfill(2) if '_' not in percent else percent}_{name}"


def key_profile(
    df: DataFrame,
    key: str,
    numbers: Mapping[str, Column],
    distinct: Mapping[str, Column],
    quantiles: Sequence[float] = (0.25, 0.5, 0.75),
    bin_values: int = 200_000,
) -> DataFrame:
    """Exact per-key counts, distinct counts, means, modes and quantiles by value-frequency compression.

    Rows are first grouped by (key, measure, value) with their frequency. Even the hottest key is
    spread over all tasks there, and copies of a value collapse on the map side. Everything else is
    derived from the weighted values: sums over bins of an order-preserving value hash give counts,
    means, modes and distinct counts; the bins in which a quantile's ranks fall are found from the
    bins' cumulated weights, and only their values are ordered, in one window per bin. A wanted bin of
    more than ``bin_values`` different values is divided again, so that a window's size does not grow with
    a key, however narrow the range of its values is.

    Columns: key, ``n_rows``, ``n_<name>`` for each of ``distinct``; ``n_``, ``mean_``, ``mode_`` and
    ``q<percent>_`` for each of ``numbers``. Nulls and NaN are skipped; a key all of whose values are
    null has a null mean, mode and quantiles. Rows with a null key come out under a null key. Ties for
    a mode go to the smaller value. Quantiles interpolate linearly. An empty input gives no row.
    """
    if bad := [q for q in quantiles if not 0 <= q <= 1]:
        raise ValueError(f"quantiles outside [0, 1]: {bad}")
    names = list(numbers)
    cells = [F.struct(F.lit(0).alias("m"), F.lit(0.0).alias("v"), F.lit(None).cast("string").alias("s"))]
    for i, c in enumerate(numbers.values(), 1):
        c = c.cast("double")
        # -0.0 and 0.0 are one value
        cells.append(F.when(c.isNotNull() & ~F.isnan(c), F.struct(F.lit(i).alias("m"), (c + F.lit(0.0)).alias("v"), F.lit(None).cast("string").alias("s"))))
    for i, c in enumerate(distinct.values(), 1 + len(names)):
        cells.append(F.when(c.isNotNull(), F.struct(F.lit(i).alias("m"), F.lit(0.0).alias("v"), c.cast("string").alias("s"))))
    stacked = df.select(F.col(key).alias("__k"), F.inline(F.filter(F.array(*cells), lambda x: x.isNotNull())))
    freq = stacked.groupBy("__k", "m", "v", "s").agg(F.count(F.lit(1)).alias("w"))
    freq = freq.withColumn("bin", F.when(F.col("s").isNotNull(), F.pmod(F.xxhash64("s"), F.lit(256)).cast("int")).otherwise(order_bin(F.col("v"))))
    freq = materialise(freq, "frequencies")  # read three times below, and far smaller than the rows

    bins = freq.groupBy("__k", "m", "bin").agg(
        F.sum("w").alias("w"),
        F.sum(F.col("w") * F.col("v")).alias("wv"),
        F.count(F.lit(1)).alias("nd"),
        F.max(F.struct(F.col("w").alias("w"), (-F.col("v")).alias("nv"))).alias("mode"),
        F.min("v").alias("lo"),
        F.max("v").alias("hi"),
    )
    over = lambda i, c: F.when(F.col("m") == i, F.col(c))
    aggs = [F.coalesce(F.sum(over(0, "w")), F.lit(0)).alias("n_rows")]
    for i, n in enumerate(names, 1):
        aggs += [
            F.coalesce(F.sum(over(i, "w")), F.lit(0)).alias(f"n_{n}"),
            F.try_divide(F.sum(over(i, "wv")), F.sum(over(i, "w"))).alias(f"mean_{n}"),
            (-F.max(over(i, "mode"))["nv"]).alias(f"mode_{n}"),
        ]
    aggs += [F.coalesce(F.sum(over(i, "nd")), F.lit(0)).alias(f"n_{n}") for i, n in enumerate(distinct, 1 + len(names))]
    base = bins.groupBy("__k").agg(*aggs)
    if not names or not quantiles:
        return base.withColumnRenamed("__k", key)

    # the ranks each quantile needs, and the bins that hold them; a null key is told by a mark of its own
    kk = F.coalesce(F.col("__k").cast("string"), F.lit("\0")).alias("kk")
    before = Window.unboundedPreceding
    per = Window.partitionBy("__k", "m")
    ranked = bins.where(F.col("m").between(1, len(names))).select(
        kk, "m", "bin", "w", "lo", "hi", "nd",
        F.coalesce(F.sum("w").over(per.orderBy("bin").rowsBetween(before, -1)), F.lit(0)).alias("before"),
        F.sum("w").over(per).alias("n"),
    )
    wanted = F.array(*[F.struct(F.lit(j).alias("q"), F.lit(float(q)).alias("p")) for j, q in enumerate(quantiles)])
    inside = lambda x: (F.ceil(x["pos"]) >= F.col("before")) & (F.floor(x["pos"]) < F.col("before") + F.col("w"))
    cells = ["kk", "m", "bin", "lo", "hi", "nd", "before", "qs"]
    needs = (
        ranked.withColumn("qs", F.filter(F.transform(wanted, lambda x: F.struct(x["q"].alias("q"), (x["p"] * (F.col("n") - 1)).alias("pos"))), inside))
        .where(F.size("qs") > 0)
        .select(*cells)
    )
    numbers_only = freq.where(F.col("s").isNull() & F.col("m").between(1, len(names))).select(kk, "m", "bin", "v", "w")
    if needs.where((F.col("nd") > bin_values) & (F.col("lo") < F.col("hi"))).isEmpty():
        rounds = 0
    else:
        needs, rounds = materialise(needs, "ranks"), 8
    for _ in range(rounds):
        wide = (F.col("nd") > bin_values) & (F.col("lo") < F.col("hi"))
        # equal steps from the least to the greatest value: the bins' rows meet again by step, not by bin
        step = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * _STEPS), F.lit(_STEPS - 1)).cast("int")
        again = numbers_only.join(needs.where(wide), ["kk", "m", "bin"]).where("v BETWEEN lo AND hi").withColumn("step", step)
        steps = again.groupBy("kk", "m", "bin", F.col("lo").alias("from"), "step").agg(
            F.sum("w").alias("w"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("nd"), F.first("before").alias("base"), F.first("qs").alias("qs")
        )
        run = F.sum("w").over(Window.partitionBy("kk", "m", "bin", "from").orderBy("step").rowsBetween(before, -1))
        finer = steps.withColumn("before", F.col("base") + F.coalesce(run, F.lit(0))).withColumn("qs", F.filter("qs", inside)).where(F.size("qs") > 0)
        needs = materialise(needs.where(~wide).unionByName(finer.select(*cells)), "ranks")
        if needs.where(wide).isEmpty():
            break
    here = Window.partitionBy("kk", "m", "bin", "least").orderBy("v").rowsBetween(before, -1)
    picked = (
        numbers_only.join(needs.withColumnsRenamed({"lo": "least", "hi": "most"}), ["kk", "m", "bin"])
        .where("v BETWEEN least AND most")
        .withColumn("lo", F.col("before") + F.coalesce(F.sum("w").over(here), F.lit(0)))
    )
    parts = (
        picked.select("kk", "m", "v", "w", "lo", F.inline("qs"))
        .select(
            "kk", "m", "q",
            (
                F.when((F.floor("pos") >= F.col("lo")) & (F.floor("pos") < F.col("lo") + F.col("w")), F.col("v") * (1 - (F.col("pos") - F.floor("pos")))).otherwise(0.0)
                + F.when((F.ceil("pos") >= F.col("lo")) & (F.ceil("pos") < F.col("lo") + F.col("w")), F.col("v") * (F.col("pos") - F.floor("pos"))).otherwise(0.0)
            ).alias("part"),
        )
    )
    qcols = [
        F.sum(F.when((F.col("m") == i) & (F.col("q") == j), F.col("part"))).alias(quantile_name(p, n))
        for i, n in enumerate(names, 1)
        for j, p in enumerate(quantiles)
    ]
    tops = parts.groupBy("kk").agg(*qcols)
    out = base.select("*", kk).join(tops, "kk", "left").drop("kk")
    return out.withColumnRenamed("__k", key)
