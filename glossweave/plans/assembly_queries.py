"""Queries of the rows that reports, screeners and exports are made of."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossweave.functions import text as tx
from glossweave.operators import assembly as asm
from glossweave.operators import composition as comp
from glossweave.operators import frames as fr
from glossweave.operators import linking as lk
from glossweave.operators import metrics as mx
from glossweave.operators.vectors import pooled_text_vector
from glossweave.plans.frames_sql import METRICS, NEG, M, Q, U, draw_sql, grid, mentions, quality, usable_mentions
from glossweave.plans.text_queries import _DOCS, _PRED, _TOK, _WIN, _docs, _pred
from glossweave.sources.readers import with_origin
from glossweave.tables import table

_BUDGET = 120


def _labelled(s, d):
    return quality(s, d).where("oov_label IS NOT NULL")


def _diagnostics(s, d):
    """Per mention its measures over all models as parallel arrays."""
    rows = _labelled(s, d).select("mention_id", F.struct("row_id", *METRICS, "oov_label").alias("x"))
    per = rows.groupBy("mention_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return per.select("mention_id", *[F.col(f"x.{c}").alias(c) for c in ("row_id", *METRICS, "oov_label")])


def _fusions(s, d):
    """The grid's combinations, and each of them fused with the next layer of its model."""
    one = table(s, d, "grid_export").select("model", "layer").distinct()
    two = one.groupBy("model").agg(F.concat(F.lit("m/"), F.min("layer"), F.lit("+n/"), F.max("layer")).alias("layer")).select(F.lit("fusion2").alias("model"), "layer").distinct()
    return one.unionByName(two)


def _assigned(s, d):
    return quality(s, d).select("row_id", "entity", "cluster", "mention")


def _pieces(s, d):
    p = _docs(s, d).select("doc", F.posexplode(tx.budget_pieces("text", _BUDGET)).alias("n", "piece"))
    sized = p.withColumn("k", F.size(tx.tokens("piece")))
    per = sized.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("n", "piece"))).alias("ps"), F.max("k").alias("k"))
    return per.select("doc", F.concat_ws("", "ps.piece").alias("text"), (F.col("k") <= _BUDGET).alias("fits"))


def _windows(s, d):
    return lk.mention_windows(_docs(s, d), "doc", "text")


def _pooled(s, d):
    rows = usable_mentions(s, d).where("itext IS NOT NULL").select("itext", F.struct("row_id", "embed").alias("x"))
    per = rows.groupBy("itext").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    layers = F.transform("xs", lambda x: F.array(x["embed"], F.transform(x["embed"], lambda v: v * 3)))
    return per.select("itext", F.posexplode(pooled_text_vector(layers, 64, 128)).alias("pos", "val")).select("itext", F.col("pos").cast("long").alias("pos"), (F.round(F.col("val") + 3e-11, 9) + 0.0).alias("val"))


_n = lambda c: F.count(F.lit(1)).alias(c)
_l = lambda c: F.col(c).cast("long").alias(c)
QUERIES = {
    "proj16_export_order": lambda s, d: asm.in_export_order(grid(s, d)).drop("ingested_at"),
    "t10_by_combination": lambda s, d: asm.by_combination(grid(s, d).select("model", "layer").distinct()),
    "proj17_placed_assignments": lambda s, d: asm.placed_assignments(_assigned(s, d), quality(s, d).select("row_id", F.array("pca_residual", "pca_mahalanobis").alias("at")), "row_id", 2).withColumn("class", F.col("class").cast("long")),
    "proj18_diagnostic_rows": lambda s, d: asm.diagnostic_rows(_diagnostics(s, d), ["mention_id"], ["row_id", *METRICS], "oov_label").drop("mention_id"),
    "proj19_aligned_frames": lambda s, d: asm.aligned({"fit": table(s, d, "kb"), "oov": table(s, d, "kb_extension").drop("example")}, ["entity_id", "label"], ["example"]),
    "proj21_known_origin": lambda s, d: with_origin(_labelled(s, d).withColumn("kb_match", F.col("oov_label") == 0), ["is_kb_match", "kb_match"]).select("row_id", asm.known_origin(F.col("origin")).cast("long").alias("y")),
    "proj22_combination_parts": lambda s, d: asm.combination_parts(_fusions(s, d)).select("model", "layer", "arity", F.array_join("base_models", ",").alias("base_models"), "layer_code"),
    "proj23_file_stems": lambda s, d: _fusions(s, d).select("model", "layer", asm.file_stem(F.col("model"), F.col("layer")).alias("stem")),
    "e16_quality_rows": lambda s, d: asm.quality_rows(_assigned(s, d), quality(s, d), _labelled(s, d), "row_id", "m", "1", 0).select("model", "layer", _l("sample_idx"), "row_id", "entity", _l("cluster"), "mention", *METRICS, _l("oov_label")),
    "e16_datapoint_scores": lambda s, d: asm.datapoint_scores([_labelled(s, d).select("row_id", "entity", _l("oov_label")), quality(s, d).select("row_id", F.col("pca_residual").alias("oov_score")), quality(s, d).select("row_id", F.col("pca_spectral_entropy").alias("combined_score"))], "row_id", "1:m/1", "m", "1", 0).withColumn("sample_idx", F.col("sample_idx").cast("long")),
    "e17_class_labels": lambda s, d: asm.checked_labels(_labelled(s, d), "quality").groupBy("class_label").agg(_n("n")),
    "o13_screener_frame": lambda s, d: asm.screener_frame(quality(s, d), 600, NEG, 7).select("row_id"),
    "q2_screener_inputs": lambda s, d: asm.screener_inputs(usable_mentions(s, d), NEG).select("row_id", "orig_idx", "entity", _l("y"), F.size("embed").cast("long").alias("dim")),
    "j14_with_predictions": lambda s, d: asm.with_predictions(mentions(s, d).select("row_id", "mention"), _pred(s, d).select(F.col("row_id").alias("mention_source_index"), "score", "cluster"), "row_id", ["score", "cluster", "absent"]).withColumn("cluster", F.col("cluster").cast("long")),
    "j17_token_groups": lambda s, d: _docs(s, d).select("doc", F.inline(asm.token_groups(tx.word_spans("text"), tx.tokens("text")))).groupBy("doc").agg(_n("n_words"), F.sum("first").cast("long").alias("firsts"), F.sum("last").cast("long").alias("lasts")),
    "j20_aligned_sources": lambda s, d: asm.aligned_sources([usable_mentions(s, d), usable_mentions(s, d).withColumn("embed", F.slice("embed", 1, 8))], ["row_id"]).select("row_id", F.size("e0").cast("long").alias("n0"), F.size("e1").cast("long").alias("n1")),
    "s9_mention_keys": lambda s, d: mentions(s, d).where("mention IS NOT NULL").select(asm.mention_key(tx.word_grouping("mention"), F.col("ichunk"), F.col("a"), F.col("b"), F.col("mention")).alias("k")).groupBy("k").agg(_n("n")).select(*[F.col(f"k.{c}").cast("long").alias(c) for c in ("wg", "ichunk", "a", "b")], "k.mention", "n"),
    "o14_draws_with_replacement": lambda s, d: asm.draw_rows(table(s, d, "kb").select(F.regexp_extract("entity_id", r"(\d+)", 1).cast("long").alias("row_id")), 1000, 3).groupBy("row_id").agg(_n("n")),
    "s4_budget_pieces": _pieces,
    "m9_pooled_text_vectors": _pooled,
    "q28_grid_curves": lambda s, d: asm.grid_curves(grid(s, d)).select("model", "layer", F.size("points").cast("long").alias("n"), F.array_join(F.transform("points", lambda p: p["min_cluster_size"].cast("string")), ",").alias("sizes"), F.size(F.from_json("json", "array<struct<dbcv:double>>")).cast("long").alias("in_json")),
    "q31_repeated_points": lambda s, d: asm.repeated_points(grid(s, d), ["model", "layer", "sample_idx", "min_cluster_size"]).select("model", "layer", _l("sample_idx"), _l("min_cluster_size"), "n"),
    "a5_first_non_null": lambda s, d: mentions(s, d).groupBy("mention").agg(fr.first_non_null("a_abs", "row_id").alias("a_abs")),
    "a4_entity_means_by_source": lambda s, d: _per_source(s, d),
    "w9_max_z": lambda s, d: mx.z_scores(quality(s, d).where("pca_residual IS NOT NULL AND pca_mahalanobis IS NOT NULL AND pca_spectral_entropy IS NOT NULL"), list(METRICS), ["model", "layer"]).select("row_id", F.round("max_z", 6).alias("max_z")),
    "w11_intervals": lambda s, d: lk.interval(mentions(s, d)).select("row_id", "x", "y"),
    "w14_repeated_names": lambda s, d: comp.consensus_names(comp.composition(quality(s, d).where("cluster IS NOT NULL AND entity IS NOT NULL"))).groupBy("name").agg(_n("n")).where("n > 1"),
    "p10_kept_windows": lambda s, d: _windows(s, d).groupBy("doc").agg(_n("n"), F.sum("a").cast("long").alias("starts"), F.sum("b").cast("long").alias("ends")),
    "s10_mention_substrings": lambda s, d: lk.mentions_in_place(lk.mention_windows(_docs(s, d), "doc", "text", with_text=True)),
    "s8_lemma_keys": lambda s, d: table(s, d, "kb").where("label IS NOT NULL").select("entity_id", tx.lemma_key(tx.tokens("label")).alias("lemma")),
    "o5_keys_left": lambda s, d: quality(s, d).select("model", "layer", _l("sample_idx")).distinct().exceptAll(quality(s, d).where("sample_idx = 0").select("model", "layer", _l("sample_idx")).distinct()),
    "o1_union_all": lambda s, d: table(s, d, "kb").select("entity_id", "label").unionByName(table(s, d, "kb_extension").select("entity_id", "label")),
    "t8_best_rows": lambda s, d: grid(s, d).groupBy("model").agg(F.max_by(F.struct("layer", _l("min_cluster_size")), F.struct(F.coalesce("dbcv", F.lit(-9.0)), "layer", "min_cluster_size", "sample_idx")).alias("b")).select("model", "b.layer", "b.min_cluster_size"),
}


def _per_source(s, d):
    """Entity means of each source (three parts of the mentions by layer of their text), one frame below the other."""
    u = usable_mentions(s, d).where("ichunk IS NOT NULL").withColumn("source", F.col("ichunk"))
    from glossweave.functions.vectors import mean_vectors

    m = mean_vectors(u, ["source", "entity"], "embed", dim=64)
    return m.select("source", "entity", F.posexplode("embed").alias("pos", "val")).select("source", "entity", F.col("pos").cast("long").alias("pos"), (F.round(F.col("val") + 3e-11, 9) + 0.0).alias("val"))


_FIT = f"(SELECT count(*) FROM q WHERE entity = '{NEG}')"
_MET = ", ".join(METRICS)
_FUS = "fs AS (SELECT DISTINCT model, layer FROM grid_export UNION SELECT DISTINCT 'fusion2', 'm/' || min(layer) || '+n/' || max(layer) FROM grid_export GROUP BY model)"
_Z = "greatest(" + ", ".join(f"CASE WHEN stddev_pop({m}) OVER w > 1e-12 THEN ({m} - avg({m}) OVER w) / stddev_pop({m}) OVER w ELSE 0 END" for m in METRICS) + ")"
SQL = {
    "proj16_export_order": "SELECT * EXCLUDE (ingested_at) FROM grid_export",
    "t10_by_combination": "SELECT DISTINCT model, layer FROM grid_export",
    "proj17_placed_assignments": f"WITH {Q} SELECT row_id, entity, cluster::BIGINT AS class, mention, pca_residual AS cviz_00, pca_mahalanobis AS cviz_01 FROM q WHERE cluster >= 0",
    "proj18_diagnostic_rows": f"WITH {Q} SELECT row_id, {_MET}, CASE oov_label WHEN 1 THEN 'negative' WHEN 0 THEN 'positive' END AS class_label FROM q WHERE oov_label IS NOT NULL",
    "proj19_aligned_frames": "SELECT 'fit' AS part, entity_id, label, example FROM kb UNION ALL SELECT 'oov', entity_id, label, NULL FROM kb_extension",
    "proj21_known_origin": f"WITH {Q} SELECT row_id, (oov_label = 0)::BIGINT AS y FROM q WHERE oov_label IS NOT NULL",
    "proj22_combination_parts": f"""WITH {_FUS}, p AS (SELECT *, [trim(x) for x in string_split(layer, '+')] AS ms FROM fs)
       SELECT model, layer, CASE WHEN model = 'fusion2' THEN model ELSE 'singleton' END AS arity, CASE WHEN model = 'fusion2' THEN array_to_string([split_part(x, '/', 1) for x in ms], ',') ELSE model END AS base_models,
       CASE WHEN model = 'fusion2' THEN array_to_string([split_part(x, '/', 2) for x in ms], ',') ELSE layer END AS layer_code FROM p""",
    "proj23_file_stems": f"WITH {_FUS} SELECT model, layer, model || '_' || replace(replace(layer, '/', '_'), '+', '__') AS stem FROM fs",
    "e16_quality_rows": f"WITH {Q} SELECT 'm' AS model, '1' AS layer, 0::BIGINT AS sample_idx, row_id, entity, cluster::BIGINT AS cluster, mention, {_MET}, oov_label FROM q",
    "e16_datapoint_scores": f"WITH {Q} SELECT '1:m/1' AS combo_key, 'm' AS model, '1' AS layer, 0::BIGINT AS sample_idx, row_id, entity, oov_label, pca_residual AS oov_score, pca_spectral_entropy AS combined_score FROM q WHERE oov_label IS NOT NULL",
    "e17_class_labels": "SELECT CASE oov_label WHEN 1 THEN 'negative' ELSE 'positive' END AS class_label, count(*) AS n FROM mention_quality_frame WHERE oov_label IS NOT NULL GROUP BY 1",
    "o13_screener_frame": f"""WITH {Q} SELECT row_id FROM (SELECT row_id, coalesce(entity = '{NEG}', false) AS neg, row_number() OVER (PARTITION BY coalesce(entity = '{NEG}', false) ORDER BY {draw_sql('row_id', 7)}, row_id) AS r,
      round_even(600.0 * {_FIT} / (SELECT count(*) FROM q), 0) AS kn FROM q) WHERE r <= CASE WHEN neg THEN kn ELSE 600 - kn END""",
    "q2_screener_inputs": f"WITH {U} SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS orig_idx, coalesce(entity, '') AS entity, coalesce((entity = '{NEG}')::BIGINT, 0) AS y, 64::BIGINT AS dim FROM u",
    "j14_with_predictions": f"WITH {_PRED} SELECT m.row_id, m.mention, score, cluster::BIGINT AS cluster FROM m LEFT JOIN pr USING (row_id)",
    "j17_token_groups": rf"""WITH {_DOCS}, {_TOK}, g AS (SELECT doc, s, i, count(*) FILTER (regexp_matches(s, '^[\s\p{{Z}}\x{{85}}\x{{1c}}-\x{{1f}}]')) OVER (PARTITION BY doc ORDER BY i) AS w FROM o),
      t AS (SELECT doc, w, row_number() OVER (PARTITION BY doc ORDER BY i) - 1 AS k FROM g WHERE NOT regexp_matches(s, '^[\s\p{{Z}}\x{{85}}\x{{1c}}-\x{{1f}}]')),
      r AS (SELECT doc, w, min(k) AS first, max(k) + 1 AS last FROM t GROUP BY ALL) SELECT doc, count(*) AS n_words, sum(first)::BIGINT AS firsts, sum(last)::BIGINT AS lasts FROM r GROUP BY doc""",
    "j20_aligned_sources": f"WITH {U} SELECT row_id, 64::BIGINT AS n0, 8::BIGINT AS n1 FROM u",
    "s9_mention_keys": rf"WITH {M}, x AS (SELECT *, len(regexp_split_to_array(trim(mention), '\s+')) AS k FROM m WHERE mention IS NOT NULL) SELECT CASE WHEN trim(mention) <> '' AND k BETWEEN 1 AND 4 THEN k END AS wg, ichunk, a, b, lower(mention) AS mention, count(*) AS n FROM x GROUP BY ALL",
    "o14_draws_with_replacement": rf"SELECT row_id, 3 + (row_number() OVER (ORDER BY {draw_sql('row_id', 3)}, row_id) <= 100)::BIGINT AS n FROM (SELECT regexp_extract(entity_id, '(\d+)', 1)::BIGINT AS row_id FROM kb)",
    "s4_budget_pieces": "SELECT doc_id AS doc, text, true AS fits FROM documents WHERE text <> ''",
    "m9_pooled_text_vectors": f"""WITH {U}, n AS (SELECT itext, [x / sqrt(list_sum([y * y for y in embed])) for x in embed] AS v FROM u WHERE itext IS NOT NULL),
      c AS (SELECT itext, unnest(v) AS x, unnest(range(64)) AS pos FROM n), t AS (SELECT itext, pos, sum(x) / 128 AS x FROM c GROUP BY ALL), l AS (SELECT itext, sqrt(sum(x * x)) AS r FROM t GROUP BY 1)
      SELECT itext, pos, round(CASE WHEN r > 0 THEN x / r ELSE x END + 3e-11, 9) + 0.0 AS val FROM t JOIN l USING (itext)""",
    "q28_grid_curves": "SELECT model, layer, count(*) AS n, string_agg(min_cluster_size::VARCHAR, ',' ORDER BY min_cluster_size) AS sizes, count(*) AS in_json FROM grid_export GROUP BY ALL",
    "q31_repeated_points": "SELECT model, layer, sample_idx::BIGINT AS sample_idx, min_cluster_size::BIGINT AS min_cluster_size, count(*) AS n FROM grid_export GROUP BY ALL HAVING count(*) > 1",
    "a5_first_non_null": f"WITH {M} SELECT mention, arg_min(a_abs, row_id) FILTER (a_abs IS NOT NULL) AS a_abs FROM m GROUP BY 1",
    "a4_entity_means_by_source": f"WITH {U}, c AS (SELECT ichunk AS source, entity, unnest(embed) AS x, unnest(range(64)) AS pos FROM u WHERE ichunk IS NOT NULL AND entity IS NOT NULL) SELECT source, entity, pos, round(avg(x) + 3e-11, 9) + 0.0 AS val FROM c GROUP BY ALL",
    "w9_max_z": f"WITH {Q} SELECT row_id, round({_Z}, 6) AS max_z FROM q WHERE pca_residual IS NOT NULL AND pca_mahalanobis IS NOT NULL AND pca_spectral_entropy IS NOT NULL WINDOW w AS (PARTITION BY model, layer)",
    "w11_intervals": f"WITH {M} SELECT row_id, CASE WHEN coalesce(b_abs, b) IS NOT NULL THEN coalesce(a_abs, a) END AS x, CASE WHEN coalesce(a_abs, a) IS NOT NULL THEN coalesce(b_abs, b) END AS y FROM m",
    "w14_repeated_names": "SELECT '' AS name, 0::BIGINT AS n WHERE false",
    "p10_kept_windows": f"WITH {_DOCS}, {_TOK}, {_WIN} SELECT doc, count(*) AS n, sum(a)::BIGINT AS starts, sum(b)::BIGINT AS ends FROM win GROUP BY doc",
    "s10_mention_substrings": f"WITH {_DOCS}, {_TOK}, {_WIN} SELECT true AS same, count(*) AS n FROM win",
    "s8_lemma_keys": r"SELECT entity_id, array_to_string([CASE WHEN length(w) > 4 THEN regexp_replace(lower(w), '(ing|ed|es|s)$', '') ELSE lower(w) END for w in regexp_extract_all(label, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')], ' ') AS lemma FROM kb WHERE label IS NOT NULL",
    "o5_keys_left": "SELECT DISTINCT model, layer, sample_idx::BIGINT AS sample_idx FROM mention_quality_frame EXCEPT SELECT DISTINCT model, layer, sample_idx::BIGINT FROM mention_quality_frame WHERE sample_idx = 0",
    "o1_union_all": "SELECT entity_id, label FROM kb UNION ALL SELECT entity_id, label FROM kb_extension",
    "t8_best_rows": "SELECT model, layer, min_cluster_size::BIGINT AS min_cluster_size FROM grid_export QUALIFY row_number() OVER (PARTITION BY model ORDER BY coalesce(dbcv, -9) DESC, layer DESC, min_cluster_size DESC, sample_idx DESC) = 1",
}
