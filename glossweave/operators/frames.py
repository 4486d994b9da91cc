"""Relational algebra of mention frames: means, fusion, rarity, caps, samples, folds, upserts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossweave.functions.vectors import mean_vectors
from glossweave.schema import KEYS, provenance_in, require
from glossweave.tables import numbered_rows


def draw(row_id: str, seed: int) -> Column:
    """A number in [0, 1000003) that only row and seed decide, the same in any engine (trap X6)."""
    return F.pmod(F.col(row_id).cast("long") * F.lit(7919) + F.lit(seed * 104729 + 17) * F.pmod(F.col(row_id).cast("long"), F.lit(1009)), F.lit(1_000_003))


def first_non_null(column: str, order: str) -> Column:
    """The value of the first row, by ``order``, in which ``column`` is not null (A5)."""
    return F.min(F.when(F.col(column).isNotNull(), F.struct(F.col(order), F.col(column))))[column]


def mean_by_keys(df: DataFrame, keys: list[str] | None = None, order: str = "row_id", dim: int | None = None) -> DataFrame:
    """One row per key: mean vector and first non-null provenance (A1). Rows with a null key are dropped."""
    keys = keys or KEYS
    require(df, [*keys, "embed", order])
    means = mean_vectors(df, keys, "embed", dim=dim)
    prov = provenance_in(df)
    if not prov:
        return means
    kept = df
    for k in keys:
        kept = kept.where(F.col(k).isNotNull())
    return means.join(kept.groupBy(*keys).agg(*[first_non_null(c, order).alias(c) for c in prov]), keys)


def fuse(frames: list[DataFrame], order: str = "row_id", dim: int | None = None) -> DataFrame:
    """Inner join of mean frames on the mention keys, vectors concatenated in source order.

    Concatenated vectors are single precision when there is more than one source (trap X7); provenance
    comes from the first source.
    """
    if not frames:
        raise ValueError("no source")
    means = [mean_by_keys(f, order=order, dim=dim) for f in frames]
    if len(means) == 1:
        return means[0]
    right = [m.select(*KEYS, F.col("embed").alias(f"__e{i}")) for i, m in enumerate(means[1:], 1)]
    joined = reduce(lambda a, b: a.join(b, KEYS), right, means[0])
    vec = F.concat("embed", *[f"__e{i}" for i in range(1, len(means))]).cast("array<float>")
    return joined.withColumn("embed", vec).drop(*[f"__e{i}" for i in range(1, len(means))])


def entity_means(df: DataFrame, labels: DataFrame | None = None, dim: int | None = None) -> DataFrame:
    """Mean vector per entity, of the given labels only if there are any (A2, A3, A4, P5)."""
    rows = df if labels is None else df.join(labels.select("entity").distinct(), "entity", "left_semi")
    return mean_vectors(rows, ["entity"], "embed", dim=dim)


def fuse_entities(frames: list[DataFrame], labels: DataFrame | None = None, dim: int | None = None) -> DataFrame:
    """Entities of all sources with their concatenated means, in double precision."""
    means = [entity_means(f, labels, dim).withColumnRenamed("embed", f"__e{i}") for i, f in enumerate(frames)]
    joined = reduce(lambda a, b: a.join(b, "entity"), means)
    return joined.select("entity", F.concat(*[f"__e{i}" for i in range(len(means))]).alias("embed"))


def first_id_by_label(kb: DataFrame) -> DataFrame:
    """(label, entity_id): for every label the first identifier in knowledge-base order ``ord`` (J4, trap X9)."""
    return kb.where("label IS NOT NULL").groupBy("label").agg(F.min(F.struct("ord", "entity_id"))["entity_id"].alias("entity_id"))


def labels_map(kb: DataFrame) -> DataFrame:
    """(entity_id, label): labels that are not null, the last one in order per identifier."""
    return kb.where("label IS NOT NULL").groupBy("entity_id").agg(F.max(F.struct("ord", "label"))["label"].alias("label"))


def keep_entities(df: DataFrame, names: DataFrame) -> DataFrame:
    """Rows whose entity is among ``names``."""
    return df.join(names.select("entity").distinct(), "entity", "left_semi")


def drop_entities(df: DataFrame, names: DataFrame) -> DataFrame:
    """Rows whose entity is not among ``names``; null entities stay."""
    return df.join(names.select("entity").distinct(), "entity", "left_anti")


def drop_rare(df: DataFrame, least: int, negative: str) -> DataFrame:
    """Rows of entities with at least ``least`` rows; the negative label and null entities stay (A6, trap X17)."""
    rare = df.where(F.col("entity").isNotNull() & (F.col("entity") != negative)).groupBy("entity").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < least)
    return drop_entities(df, rare)


def cap_per_entity(df: DataFrame, most: int, negative: str, most_negative: int | None = None, seed: int = 0, row_id: str = "row_id") -> DataFrame:
    """At most ``most`` rows per entity in the order of a seeded hash; negatives have their own cap or none (W1, trap X16)."""
    if most < 1 or (most_negative is not None and most_negative < 1):
        raise ValueError("caps must be positive")
    neg = F.coalesce(F.col("entity") == negative, F.lit(False))
    rank = F.row_number().over(Window.partitionBy("entity").orderBy(draw(row_id, seed), row_id))
    positives = df.where(~neg & F.col("entity").isNotNull()).withColumn("__r", rank).where(F.col("__r") <= most).drop("__r")
    negatives = df.where(neg)
    if most_negative is not None:
        negatives = top_by_draw(negatives, most_negative, seed, row_id)
    return positives.unionByName(negatives).unionByName(df.where(F.col("entity").isNull()))


#: Draws fall into buckets of so many values, about a thousand buckets in all.
_DRAW_BUCKET = 1000
#: Up to so many rows are taken by a plain ordered limit.
_SMALL_TAKE = 10_000


def top_by_draw(df: DataFrame, n: int, seed: int, row_id: str = "row_id") -> DataFrame:
    """``n`` rows without replacement: those with the smallest seeded hash.

    A small sample is an ordered limit. For a large one the rows of each hash bucket are counted (about a
    thousand counts); whole buckets are taken as they are, and only the one in which the sample ends is ordered.
    """
    if n <= _SMALL_TAKE:
        return df.orderBy(draw(row_id, seed), row_id).limit(n)
    bucket = F.floor(draw(row_id, seed) / _DRAW_BUCKET)
    taken = 0
    for r in sorted(df.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("k")).collect()):
        if taken + r["k"] > n:
            last = df.where(bucket == r["b"]).orderBy(draw(row_id, seed), row_id).limit(n - taken)
            return df.where(bucket < r["b"]).unionByName(last)
        taken += r["k"]
    return df


def rank_by_draw(df: DataFrame, by: str, seed: int, row_id: str = "row_id") -> DataFrame:
    """The frame with ``__rank``, from 0, of every row among those of its ``by`` value in the order of a seeded hash.

    Counts per (value, hash bucket) are cumulated and only buckets are ordered, so that a value with most of
    the rows is spread over about a thousand windows.
    """
    keyed = df.withColumns({"__bucket": F.floor(draw(row_id, seed) / _DRAW_BUCKET), "__by": F.coalesce(F.col(by).cast("string"), F.lit("\0"))})
    counts = keyed.groupBy("__by", "__bucket").agg(F.count(F.lit(1)).alias("__k"))
    before = Window.partitionBy("__by").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__by", "__bucket", F.coalesce(F.sum("__k").over(before), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy("__by", "__bucket").orderBy(draw(row_id, seed), row_id)) - 1
    ranked = keyed.withColumn("__r", inside).join(starts, ["__by", "__bucket"])
    return ranked.withColumn("__rank", F.col("__start") + F.col("__r")).drop("__by", "__bucket", "__start", "__r")


def sample_size(n: int, rows: int) -> int:
    """min(n, rows)."""
    return min(n, rows)


def stratified_counts(target: int, n_negative: int, n_positive: int) -> tuple[int, int]:
    """(negatives, positives) in proportion, at least one of each class that has rows, then trimmed to the target (O8, trap X18)."""
    total = n_negative + n_positive
    if not total:
        return 0, 0
    neg = min(n_negative, max(1, round(target * n_negative / total))) if n_negative else 0
    pos = min(n_positive, max(1, target - neg)) if n_positive else 0
    while neg + pos > target and max(neg, pos) > 1:
        if neg >= pos:
            neg -= 1
        else:
            pos -= 1
    while neg + pos < min(target, total):
        if pos < n_positive:
            pos += 1
        else:
            neg += 1
    return neg, pos


def stratified_sample(df: DataFrame, n: int, negative: str, seed: int = 0, row_id: str = "row_id") -> DataFrame:
    """``n`` rows with both classes in proportion; all rows when there are no more."""
    is_neg = F.coalesce(F.col("entity") == negative, F.lit(False))
    counts = df.agg(F.count(F.when(is_neg, 1)).alias("neg"), F.count(F.lit(1)).alias("all")).first()
    if n >= counts["all"]:
        return df
    neg, pos = stratified_counts(n, counts["neg"], counts["all"] - counts["neg"])
    return top_by_draw(df.where(is_neg), neg, seed, row_id).unionByName(top_by_draw(df.where(~is_neg), pos, seed, row_id))


def balanced_sample(df: DataFrame, n: int, by: str, seed: int = 0, row_id: str = "row_id") -> DataFrame:
    """At most n / classes rows of every class."""
    classes = df.select(by).distinct().count()
    rank = F.row_number().over(Window.partitionBy(by).orderBy(draw(row_id, seed), row_id))
    return df.withColumn("__r", rank).where(F.col("__r") <= n // max(1, classes)).drop("__r")


def folds(df: DataFrame, by: str, k: int, seed: int = 0, row_id: str = "row_id") -> DataFrame:
    """The frame with a stratified ``fold`` in 0..k-1 (O15); a fold is a test set, the rest its training set."""
    return rank_by_draw(df, by, seed, row_id).withColumn("fold", F.pmod("__rank", F.lit(k)).cast("long")).drop("__rank")


def keep_last(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One row per key, the newest by ``order`` (O3, trap X10)."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__r", rank).where("__r = 1").drop("__r")


def upsert(prior: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both, those of ``new`` instead of prior ones with the same key (K2, K3, K4, O1)."""
    both = prior.withColumn("__gen", F.lit(0)).unionByName(new.withColumn("__gen", F.lit(1)), allowMissingColumns=True)
    return keep_last(both, keys, [F.desc("__gen"), *[c for c in prior.columns if c not in keys]]).drop("__gen")


def selection_frame(
    frames: list[DataFrame], negative: str, labels: DataFrame | None = None, least: int | None = None, most: int | None = None, most_negative: int | None = None, seed: int = 0
) -> DataFrame:
    """Fuse, keep the selected labels, drop rare entities, cap (Q1): one lazy chain."""
    out = fuse(frames)
    if labels is not None:
        out = keep_entities(out, labels)
    if least is not None:
        out = drop_rare(out, least, negative)
    if most is not None:
        keyed = out.withColumn("row_id", F.pmod(F.xxhash64(*KEYS), F.lit(2**31)))
        out = cap_per_entity(keyed, most, negative, most_negative, seed).drop("row_id")
    return out


def one_sample_per_combo(df: DataFrame) -> DataFrame:
    """Rows of the smallest sample_idx of each (model, layer)."""
    least = df.groupBy("model", "layer").agg(F.min("sample_idx").alias("__m"))
    same = lambda c: F.col(f"f.{c}").eqNullSafe(F.col(f"l.{c}"))
    # one row per combination, and as large a share of the rows may belong to one: the optimiser broadcasts the small side
    joined = df.alias("f").join(least.alias("l"), same("model") & same("layer") & (F.col("f.sample_idx") == F.col("__m")))
    return joined.select("f.*")


def merge_knowledge_bases(kb: DataFrame) -> DataFrame:
    """First row per identifier by description, then first per label by identifier; nulls last."""
    clean = kb.where(F.col("label").isNotNull() & ~F.col("label").contains("not for use in curation") & ~F.col("label").contains("obsolete"))
    by_id = keep_last(clean, ["entity_id"], [F.asc_nulls_last("description"), F.asc_nulls_last("label"), F.asc_nulls_last("example")])
    return keep_last(by_id, ["label"], [F.asc("entity_id")])


def number_entities(df: DataFrame, start: int, prefix: str = "KB") -> DataFrame:
    """Identifiers for labels without one, numbered by label from ``start``."""
    ranked = df.where("entity_id IS NULL").select("label").distinct()
    numbered = numbered_rows(ranked, ["label"], "n").withColumn("n", F.col("n") + F.lit(start))
    return numbered.select("label", F.format_string(f"{prefix}.%06d", F.col("n")).alias("entity_id"))
