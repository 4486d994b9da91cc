"""Rows put together for reports, screeners and exports: labels, diagnostics, coordinates, keys, aligned sources."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossweave.operators.frames import draw, stratified_sample
from glossweave.tables import numbered_rows

#: The column order of the grid export.
GRID_COLUMNS = ["model", "layer", "sample_idx", "chosen_min_cluster_size", "min_cluster_size", "icm", "n_clusters", "dbcv", "ari"]
QUALITY = ["pca_residual", "pca_mahalanobis", "pca_spectral_entropy"]
#: Models that stand for a combination of layers of several models, and origins that count as known.
FUSIONS = ("fusion2", "fusion3")
KNOWN_ORIGINS = ("from_fit", "kb_match")


def in_export_order(df: DataFrame) -> DataFrame:
    """The export's columns in their order, further ones behind them as they come."""
    first = [c for c in GRID_COLUMNS if c in df.columns]
    return df.select(*first, *[c for c in df.columns if c not in first])


def by_combination(df: DataFrame) -> DataFrame:
    """Rows by model and layer."""
    return df.orderBy("model", "layer")


def placed_assignments(assignments: DataFrame, coordinates: DataFrame, row_id: str, dims: int, exclude_noise: bool = True) -> DataFrame:
    """Assignments beside their coordinates ``at`` as columns cviz_00 onwards, the cluster as ``class``.

    Rows join by ``row_id``; those without coordinates are left out, and noise (-1 or null) too unless kept.
    """
    rows = assignments.where("cluster >= 0") if exclude_noise else assignments
    extra = [c for c in ("pmid", "mention", "a_abs", "b_abs", "screener_score", "cluster_score") if c in assignments.columns]
    both = rows.join(coordinates.select(row_id, "at"), row_id)
    return both.select(row_id, "entity", F.col("cluster").alias("class"), *extra, *[F.get("at", F.lit(i)).alias(f"cviz_{i:02d}") for i in range(dims)])


def diagnostic_rows(diagnostics: DataFrame, keys: list[str], columns: list[str], label: str) -> DataFrame:
    """Parallel arrays as rows, with ``class_label`` for the 0/1 array ``label``."""
    zipped = diagnostics.select(*keys, F.explode(F.arrays_zip(*columns, label)).alias("x"))
    return zipped.select(*keys, *[F.col(f"x.{c}").alias(c) for c in columns], class_text(F.col(f"x.{label}")).alias("class_label"))


def class_text(label: Column) -> Column:
    """negative for 1, positive for 0, null otherwise."""
    return F.when(label == 1, "negative").when(label == 0, "positive")


def aligned(frames: dict[str, DataFrame], shared: list[str], optional: list[str]) -> DataFrame:
    """Frames under each other with their names as ``part``: shared columns, and optional ones that some lack, as null."""
    parts = [f.select(F.lit(n).alias("part"), *shared, *[F.col(c) for c in optional if c in f.columns]) for n, f in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def known_origin(origin: Column) -> Column:
    """1 where the origin is a known one, else 0."""
    return F.coalesce(origin.isin(*KNOWN_ORIGINS), F.lit(False)).cast("int")


def combination_parts(df: DataFrame) -> DataFrame:
    """The frame with ``arity``, ``base_models`` and ``layer_code`` of its model and layer.

    A fusion's layer lists its members as model/layer, joined by plus signs; a single model stands for itself.
    """
    fused = F.col("model").isin(*FUSIONS)
    members = F.filter(F.transform(F.split("layer", r"\+"), F.trim), lambda x: x != "")
    models = F.filter(F.transform(members, lambda x: F.when(F.contains(x, F.lit("/")), F.substring_index(x, "/", 1)).otherwise(x)), lambda x: x != "")
    specs = F.transform(members, lambda x: F.when(F.contains(x, F.lit("/")), x.substr(F.instr(x, "/") + 1, F.length(x))).otherwise(x))
    return df.withColumns({
        "arity": F.when(fused, F.col("model")).otherwise("singleton"),
        "base_models": F.when(fused & (F.size(models) > 0), models).otherwise(F.array("model")),
        "layer_code": F.when(fused & (F.size(specs) > 0), F.array_join(specs, ",")).otherwise(F.col("layer")),
    })


def file_stem(model: Column, layer: Column) -> Column:
    """model_layer with signs that file names bear: _ for /, __ for +."""
    return F.concat_ws("_", model, F.replace(F.replace(layer, F.lit("/"), F.lit("_")), F.lit("+"), F.lit("__")))


def checked_labels(df: DataFrame, source: str) -> DataFrame:
    """The frame with ``class_label``, after one aggregation that refuses labels which are null, not 0 or 1, or all the same."""
    if "oov_label" not in df.columns:
        raise ValueError(f"{source}: no column oov_label")
    x = F.col("oov_label").try_cast("double")
    n = df.agg(F.count_if(x.isNull() | F.isnan(x)).alias("none"), F.count_if(~x.isin(0.0, 1.0)).alias("other"), F.count_if(x == 1).alias("neg"), F.count_if(x == 0).alias("pos")).first()
    if n["none"] or n["other"]:
        raise ValueError(f"{source}: {n['none']} labels missing, {n['other']} neither 0 nor 1")
    if not n["neg"] or not n["pos"]:
        raise ValueError(f"{source}: only one class ({n['neg']} negative, {n['pos']} positive)")
    return df.withColumn("class_label", class_text(x))


def quality_rows(assignments: DataFrame, metrics: DataFrame, labels: DataFrame, row_id: str, model: str, layer: str, sample_idx: int) -> DataFrame:
    """model, layer, sample_idx, entity, cluster, then article and mention where known, the quality metrics and ``oov_label``.

    One row for each assignment; metrics and labels join by ``row_id`` and are null where there are none.
    """
    optional = [c for c in ("pmid", "mention") if c in assignments.columns]
    joined = assignments.join(metrics.select(row_id, *QUALITY), row_id, "left").join(labels.select(row_id, "oov_label"), row_id, "left")
    return joined.select(F.lit(model).alias("model"), F.lit(layer).alias("layer"), F.lit(sample_idx).alias("sample_idx"), row_id, "entity", "cluster", *optional, *QUALITY, "oov_label")


def datapoint_scores(scores: list[DataFrame], row_id: str, combo_key: str, model: str, layer: str, sample_idx: int) -> DataFrame:
    """One row per data point with every score frame's columns side by side, under its combination."""
    joined = reduce(lambda a, b: a.join(b, row_id), scores)
    head = {"combo_key": combo_key, "model": model, "layer": layer, "sample_idx": sample_idx}
    return joined.select(*[F.lit(v).alias(k) for k, v in head.items()], *joined.columns)


def screener_frame(prepared: DataFrame, most: int | None, negative: str, seed: int, clustered: DataFrame | None = None, row_id: str = "row_id") -> DataFrame:
    """Rows a screener is fitted on: the clustering's own if they are fewer, else all, or a stratified ``most`` of them."""
    n = prepared.count()
    if clustered is not None and clustered.count() < n:
        return clustered
    return prepared if most is None or n <= most else stratified_sample(prepared, most, negative, seed, row_id)


def screener_inputs(df: DataFrame, negative: str, order: str = "row_id") -> DataFrame:
    """``orig_idx`` in the order given, entity, y (1 for the negative label), the vector, and the quality metrics as ``x`` (Q2)."""
    y = F.coalesce((F.col("entity") == negative).cast("int"), F.lit(0))
    metrics = [F.array(*[F.col(c).cast("double") for c in QUALITY]).alias("x")] if set(QUALITY) <= set(df.columns) else []
    rows = df.select(order, F.coalesce("entity", F.lit("")).alias("entity"), y.alias("y"), "embed", *metrics)
    return numbered_rows(rows, [order], "orig_idx")


def with_predictions(mentions: DataFrame, predictions: DataFrame, index: str, fields: list[str]) -> DataFrame:
    """Mentions (``index``) with the fields of the prediction made from them; predictions of no mention are ignored."""
    p = predictions.where(F.col("mention_source_index") >= 0).select(F.col("mention_source_index").alias(index), *[c for c in fields if c in predictions.columns])
    return mentions.join(p, index, "left")


def aligned_sources(frames: list[DataFrame], keys: list[str], vector: str = "embed") -> DataFrame:
    """Mentions of several sources side by side, each source's vector as e0, e1 ...; refused unless all have the same mentions."""
    named = [f.select(*keys, F.col(vector).alias(f"e{i}")) for i, f in enumerate(frames)]
    joined = reduce(lambda a, b: a.join(b, keys, "full"), named)
    missing = joined.where(reduce(lambda a, b: a | b, [F.col(f"e{i}").isNull() for i in range(len(named))])).limit(1).count()
    if missing:
        raise ValueError("sources differ in their mentions")
    return joined


def paths_by_combination(found: list[tuple[str, str, str]], wanted: list[tuple[str, str]]) -> list[str]:
    """The paths of the wanted (model, layer) pairs, in their order; an error names what is missing."""
    at = {(m, layer): p for m, layer, p in found}
    if lost := [w for w in wanted if w not in at]:
        raise ValueError(f"no file for {lost}")
    return [at[w] for w in wanted]


def mention_key(wg: Column, ichunk: Column, a: Column, b: Column, mention: Column) -> Column:
    """Identity of a mention, its text without case."""
    return F.struct(wg.alias("wg"), ichunk.alias("ichunk"), a.alias("a"), b.alias("b"), F.lower(mention).alias("mention"))


def draw_rows(df: DataFrame, k: int, seed: int = 0, row_id: str = "row_id") -> DataFrame:
    """``k`` rows: without replacement while there are enough, else each as often as k rounds of the pool give.

    Draws with replacement go round the pool in the order of a seeded hash, so counts differ by one at most.
    """
    from glossweave.operators.frames import top_by_draw

    n = df.count()
    if not n or k <= n:
        return top_by_draw(df, k, seed, row_id)
    whole = df.withColumn("__i", F.explode(F.sequence(F.lit(1), F.lit(k // n)))).drop("__i")
    return whole.unionByName(top_by_draw(df, k % n, seed, row_id)) if k % n else whole


def grid_curves(grid: DataFrame) -> DataFrame:
    """Per (model, layer) its points in the order of their size, as an array and as JSON (Q28)."""
    point = F.struct("min_cluster_size", "dbcv", "ari", "n_clusters")
    per = grid.groupBy("model", "layer").agg(F.array_sort(F.collect_list(point)).alias("points"))  # as many points as the grid has sizes
    return per.withColumn("json", F.to_json("points"))


def repeated_points(grid: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number: none in a valid grid (Q31)."""
    return grid.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def token_groups(words: Column, toks: Column) -> Column:
    """array<struct<a, b, first, last>>: for each distinct word span the run of tokens that overlap it, half-open.

    Both are arrays of structs, words with a and b, tokens (in order, not overlapping) with ix and ix_end. Words
    without a token are left out.
    """
    return F.arrow_udf(_token_runs, "array<struct<a:int,b:int,first:int,last:int>>")(words, toks)


def _token_runs(words: pa.Array, toks: pa.Array) -> pa.Array:
    """``token_groups`` over a batch: both sides searched by position."""
    out, ends = [], [0]
    pick = lambda arr, names: [arr.flatten().field(n).to_pylist() for n in names]
    wa, wb = pick(words, ("a", "b"))
    ta, tb = pick(toks, ("ix", "ix_end"))
    i = j = 0
    for nw, nt in zip(words.value_lengths().fill_null(0).to_pylist(), toks.value_lengths().fill_null(0).to_pylist()):
        starts, stops = ta[j : j + nt], tb[j : j + nt]
        for a, b in dict.fromkeys(zip(wa[i : i + nw], wb[i : i + nw])):
            first, last = bisect_right(stops, a), bisect_left(starts, b)
            if first < last:
                out.append({"a": a, "b": b, "first": first, "last": last})
        i, j = i + nw, j + nt
        ends.append(len(out))
    kind = pa.struct([(n, pa.int32()) for n in ("a", "b", "first", "last")])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out, kind))
