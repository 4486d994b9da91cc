"""Cluster composition, grids and evaluation over the quality frame and the grid export."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossweave.operators import composition as comp
from glossweave.operators import grid as gr
from glossweave.operators import metrics as mx
from glossweave.operators.frames import keep_last
from glossweave.operators.skew import key_profile
from glossweave.plans.frames_sql import METRICS, NEG, Q, U, grid, quality, usable_mentions

_r = lambda c, n=6: (F.round(F.col(c) + 3e-11, n) + 0.0).alias(c)
_l = lambda c: F.col(c).cast("long").alias(c)


def _q(s, d):
    return quality(s, d).where("entity IS NOT NULL AND cluster IS NOT NULL")


def _labels(s, d):
    return quality(s, d).where("entity IS NOT NULL").select("entity").distinct().withColumn("entity_id", F.concat(F.lit("id:"), "entity"))


def _g(s, d):
    return keep_last(grid(s, d), gr.PK, [F.desc("ingested_at"), F.desc_nulls_last("icm")]).withColumn("sample_idx", F.col("sample_idx").cast("long"))


def _scores(s, d):
    return _g(s, d).groupBy("model", "layer").agg(F.round(F.avg("dbcv") + 3e-11, 6).alias("score"))


def _lab(s, d):
    return quality(s, d).where("oov_label IS NOT NULL")




def _solved(df, *keys):
    return df.select(*keys, "chosen", "selection", _r("score"), _r("n_clusters"))


QUERIES = {
    "t3_cluster_composition": lambda s, d: comp.composition_table(_q(s, d), 3).select(_l("cluster"), "entity", _r("mass")),
    "a7_composition": lambda s, d: comp.composition(_q(s, d)).select(_l("cluster"), "entity", "n", _r("within"), _r("capture")),
    "a8_entity_mass": lambda s, d: comp.entity_mass(_q(s, d)).select(_l("cluster"), "entity", _r("mass")),
    "a9_entity_weights": lambda s, d: comp.with_entity_weights(_q(s, d)).select("row_id", _r("weight")),
    "a10_emergent_clusters": lambda s, d: comp.count_emergent(quality(s, d)),
    "a11_mass_summary": lambda s, d: comp.mass_summary(quality(s, d)).select("n_rows", "n_clusters", "n_noise", _r("noise_fraction")),
    "a12_modal_cluster": lambda s, d: comp.modal_cluster(_q(s, d)).select("entity", _l("cluster")),
    "a13_provisional_assignments": lambda s, d: comp.provisional_assignments(_labels(s, d), _q(s, d)).select("entity_id", _l("cluster")),
    "a31_emergent_catalogue": lambda s, d: comp.emergent_catalogue(_q(s, d)).select(_l("cluster"), _r("weighted_mass"), "mention_count", _r("dominant_fraction"), _l("rank"), "entity", _r("within"), _r("capture")),
    "t1_top_clusters": lambda s, d: comp.top_clusters(comp.entity_mass(_q(s, d)), 10).select(_l("cluster"), _r("total")),
    "t2_limit_flow": lambda s, d: comp.limit_flow(comp.composition_table(_q(s, d), 4), 12, 9).select(_l("cluster"), "entity", _r("mass")),
    "w2_top_n_and_other": lambda s, d: comp.top_n_and_other(comp.entity_mass(_q(s, d), weighted=False), 5).select(_l("cluster"), "entity", _r("mass")),
    "proj8_emergent_rows": lambda s, d: comp.emergent(quality(s, d)).select("row_id", _l("cluster")),
    "s16_consensus_names": lambda s, d: comp.consensus_names(comp.composition(_q(s, d).where(f"entity <> '{NEG}'"))).select(_l("cluster"), "name"),
    "s17_derived_labels": lambda s, d: comp.derived_labels(comp.provisional_assignments(_labels(s, d), _q(s, d)), comp.composition(_q(s, d))),
    "a14_aggregate_grid": lambda s, d: gr.aggregate_grid(_g(s, d)).select(_l(gr.SIZE), *[_r(f"{m}_{k}") for m in ("dbcv", "ari") for k in ("mean", "std")], "dbcv_count", "ari_count", _r("icm_mean"), _r("n_clusters_mean")),
    "a20_search_summary": lambda s, d: gr.summarise_search(_g(s, d), 45).select("model", "layer", *[_r(f"{c}_{k}") for c in ("size", "score", "ari") for k in ("mean", "std")]),
    "a21_clusters_at": lambda s, d: gr.clusters_at(_g(s, d), 30, ["model", "layer"]).select("model", "layer", _l("n_clusters")),
    "a22_resolved_size": lambda s, d: gr.resolved_size(_g(s, d), gr.COMBO),
    "a19_pooled_metrics": lambda s, d: gr.pool_metrics(_g(s, d).withColumn("kind", F.when(F.col("n_clusters") > 30, "many").otherwise("few")), gr.COMBO, ["dbcv", "ari"], "kind").select("model", "layer", *[_r(f"{m}_{k}") for m in ("dbcv", "ari") for k in ("mean", "std")], "kind"),
    "a23_leaderboard": lambda s, d: gr.leaderboard(_scores(s, d)),
    "w3_smoothed": lambda s, d: gr.smooth(gr.aggregate_grid(_g(s, d), gr.COMBO), "dbcv_mean", gr.SIZE, 4, gr.COMBO).select("model", "layer", _l(gr.SIZE), _r("y_smooth")),
    "w4_weighted_smooth": lambda s, d: gr.smooth(gr.aggregate_grid(_g(s, d), gr.COMBO).where("dbcv_mean IS NOT NULL"), "dbcv_mean", gr.SIZE, 3, gr.COMBO, "dbcv_count").select("model", "layer", _l(gr.SIZE), _r("y_smooth")),
    "w5_gradient": lambda s, d: gr.gradient(gr.aggregate_grid(_g(s, d).where("min_cluster_size <> 25"), gr.COMBO), "dbcv_mean", gr.SIZE, gr.COMBO, "dy").select("model", "layer", _l(gr.SIZE), _r("dy")),
    "w6_min_max_curve": lambda s, d: gr.aggregate_grid(_g(s, d), gr.COMBO).withColumn("y", gr.min_max("dbcv_mean", gr.COMBO, 1.0)).select("model", "layer", _l(gr.SIZE), _r("y")),
    "w7_min_max_fold": lambda s, d: quality(s, d).groupBy("model", "layer").agg(F.avg("pca_residual").alias("v")).withColumn("y", gr.min_max("v", ["model"], 0.5)).select("model", "layer", _r("y")),
    "w16_points_at_chosen": lambda s, d: gr.points_at_chosen(_g(s, d)).select("model", "layer", "sample_idx", _l(gr.SIZE), _r("ari")),
    "m19_combined_objective": lambda s, d: _combined(s, d),
    "m21_solve_sizes": lambda s, d: _solved(gr.solve_sizes(gr.aggregate_grid(_g(s, d), gr.COMBO), gr.COMBO), "model", "layer"),
    "m22_solve_pooled": lambda s, d: _solved(gr.solve_sizes(gr.aggregate_grid(_g(s, d)), [], window=5)),
    "m22_solve_lower_bound": lambda s, d: _solved(gr.solve_sizes(gr.aggregate_grid(_g(s, d), gr.COMBO), gr.COMBO, method="lower_bound", strength=0.5), "model", "layer"),
    "m23_apply_chosen": lambda s, d: gr.apply_chosen(_g(s, d), gr.resolved_size(_g(s, d).where("layer = '1'"), gr.COMBO)).select("model", "layer", "sample_idx", _l(gr.SIZE), _l("chosen_min_cluster_size")),
    "m25_scaled_flow": lambda s, d: gr.scale_to_band(comp.composition_table(_q(s, d), 3).withColumn("cluster", F.col("cluster").cast("string")), "mass", ["cluster", "entity"], 5.0).select("cluster", "entity", _r("mass")),
    "t4_ranked_entries": lambda s, d: gr.ranked_entries(_scores(s, d), "score", 3, gr.COMBO),
    "t7_fusion_pairs": lambda s, d: gr.fusion_candidates(_scores(s, d), 2, 5).select("members", _r("score")),
    "t7_fusion_triples": lambda s, d: gr.fusion_candidates(_scores(s, d), 3, 4).select("members", _r("score")),
    "o6_pivot_scores": lambda s, d: gr.pivot_metric(_scores(s, d).where("layer IN ('1', '1,2,3')").withColumn("layer", F.when(F.col("layer") == "1", "one").otherwise("three")), "score", ["one", "three"]),
    "a16_adjusted_rand": lambda s, d: mx.adjusted_rand(comp.emergent(quality(s, d)), "entity", "cluster").select(_r("ari")),
    "a17_fit_metrics": lambda s, d: comp.mass_summary(_q(s, d)).join(mx.adjusted_rand(comp.emergent(_q(s, d)), "entity", "cluster"), F.lit(True)).select("n_clusters", _r("noise_fraction"), _r("ari")),
    "a18_mean_cosine": lambda s, d: mx.cosine_spread(usable_mentions(s, d).where("entity IS NOT NULL"), "entity", "embed", 64).where("n > 1").select("entity", "n", _r("mean_cosine")),
    "a18_cosine_deviation": lambda s, d: mx.cosine_deviation(usable_mentions(s, d).where("entity IS NOT NULL"), "entity", "embed", "row_id", 64).select("entity", "n_pairs", _r("std")),
    "a24_metric_quantiles": lambda s, d: mx.quantile_table(quality(s, d), list(METRICS), [0.5, 0.9, 0.95, 0.99]).select("metric", "q", _r("value")),
    "a25_medians_by_class": lambda s, d: key_profile(_lab(s, d), "oov_label", {m: F.col(m) for m in METRICS}, {}, [0.5]).select("oov_label", *[(F.round(F.col(f"q50_{m}") + 3e-11, 6) + 0.0).alias(m) for m in METRICS]),
    "a26_spearman": lambda s, d: mx.spearman(quality(s, d), "pca_residual", "pca_mahalanobis").select(_r("rho")),
    "a27_ellipses": lambda s, d: mx.ellipse(_g(s, d), "dbcv", "ari", gr.COMBO).select("model", "layer", *[_r(c) for c in ("mx", "my", "covariance", "major", "minor")]),
    "w8_z_scores": lambda s, d: mx.z_scores(quality(s, d), list(METRICS), ["model", "layer"]).select("row_id", *[_r(f"z_{m}") for m in METRICS], _r("max_z")),
    "w17_roc_pr_curve": lambda s, d: mx.curve(_lab(s, d), "oov_label", "pca_residual").select("threshold", "tp", "fp", *[_r(c) for c in ("tpr", "fpr", "precision", "f1")]),
    "w17_average_precision": lambda s, d: mx.average_precision(mx.curve(_lab(s, d), "oov_label", "pca_residual")).select(_r("average_precision")),
    "w18_auc": lambda s, d: mx.auc(_lab(s, d), "oov_label", "pca_mahalanobis").select(_r("auc")),
    "w19_best_f1": lambda s, d: mx.best_f1(mx.curve(_lab(s, d), "oov_label", "pca_residual")).select("threshold", _r("f1")),
    "e12_binary_metrics": lambda s, d: mx.binary_metrics(_lab(s, d), "oov_label", "pca_residual", ["model", "layer"], 0.8).select("model", "layer", _r("precision"), _r("recall"), _r("f1")),
    "m24_operating_points": lambda s, d: mx.operating_points(_lab(s, d), "oov_label", "pca_residual", "pca_mahalanobis", 2.0, 3.0).select("point", _r("intercept"), _r("precision"), _r("recall"), _r("f1")),
    "proj20_signed_distance": lambda s, d: quality(s, d).select("row_id", mx.signed_distance(F.col("pca_residual"), F.col("pca_mahalanobis"), *mx.boundary(0.0, 1.0, 2.0, 7.0)).alias("x")).select("row_id", _r("x")),
}


def _combined(s, d):
    m, sd, n = gr.combine("dbcv", "ari")
    return gr.aggregate_grid(_g(s, d), gr.COMBO).select("model", "layer", _l(gr.SIZE), m.alias("mean"), sd.alias("std"), n.alias("n"), gr.precision_weight(sd, n).alias("w"), gr.cluster_reward(F.col("n_clusters_mean"), 0.2, 20).alias("reward")).select("model", "layer", gr.SIZE, _r("mean"), _r("std"), "n", _r("w", 3), _r("reward"))


def _rs(c, n=6):
    return f"round({c} + 3e-11, {n}) + 0.0 AS {c.split('.')[-1]}"


_QC = Q + ", c AS (SELECT * FROM q WHERE entity IS NOT NULL AND cluster IS NOT NULL), e AS (SELECT * FROM c WHERE cluster <> -1)"
_MASS = _QC + ", mass AS (SELECT cluster, entity, n / sqrt(sum(n) OVER (PARTITION BY entity)) AS mass FROM (SELECT cluster, entity, count(*) AS n FROM e GROUP BY ALL))"
_COMP = "comp AS (SELECT cluster, entity, n, n / sum(n) OVER (PARTITION BY cluster) AS within, n / sum(n) OVER (PARTITION BY entity) AS capture FROM (SELECT cluster, entity, count(*) AS n FROM {} GROUP BY ALL))"


def _top(src, n):
    return f"""(SELECT cluster, CASE WHEN r <= {n} THEN entity ELSE 'Other (' || cnt || ' terms)' END AS entity, sum(mass) AS mass FROM (SELECT *, greatest(0, count(*) OVER (PARTITION BY cluster) - {n}) AS cnt,
      row_number() OVER (PARTITION BY cluster ORDER BY round(mass, 9) DESC, entity) AS r FROM {src}) GROUP BY ALL)"""


_MODAL = "modal AS (SELECT entity, cluster FROM (SELECT entity, cluster, row_number() OVER (PARTITION BY entity ORDER BY count(*) DESC, cluster) AS r FROM e GROUP BY entity, cluster) WHERE r = 1)"
_LASTG = "g AS (SELECT * FROM grid_export QUALIFY row_number() OVER (PARTITION BY model, layer, sample_idx, min_cluster_size ORDER BY ingested_at DESC, icm DESC NULLS LAST) = 1)"


def _agg(by):
    ks = ", ".join([*by, "min_cluster_size"])
    return f"""ag AS (SELECT {ks}, avg(dbcv) AS dbcv_mean, CASE WHEN count(dbcv) > 0 THEN coalesce(stddev_samp(dbcv), 0) END AS dbcv_std, count(dbcv) AS dbcv_count, avg(ari) AS ari_mean,
      CASE WHEN count(ari) > 0 THEN coalesce(stddev_samp(ari), 0) END AS ari_std, count(ari) AS ari_count, avg(icm) AS icm_mean, avg(n_clusters) AS n_clusters_mean FROM g GROUP BY ALL)"""


_COMBINED = """cb AS (SELECT *, CASE WHEN dbcv_mean IS NOT NULL AND ari_mean IS NOT NULL THEN (dbcv_mean + ari_mean) / 2 ELSE coalesce(dbcv_mean, ari_mean) END AS mean,
  CASE WHEN dbcv_mean IS NOT NULL AND ari_mean IS NOT NULL THEN sqrt((dbcv_std * dbcv_std + ari_std * ari_std) / 4) ELSE coalesce(dbcv_std, ari_std) END AS std,
  CASE WHEN dbcv_mean IS NOT NULL AND ari_mean IS NOT NULL THEN least(dbcv_count, ari_count) WHEN dbcv_mean IS NOT NULL THEN dbcv_count ELSE ari_count END AS n FROM ag)"""


def _solve(by, h, y, weight):
    p = "PARTITION BY " + ", ".join(by) if by else ""
    ks = "".join(f"{b}, " for b in by)
    ys = f"sum({weight} * y) OVER f / sum({weight}) OVER f" if weight else "avg(y) OVER f"
    join = " AND ".join(f"a.{b} = t.{b}" for b in by) or "true"
    return f"""WITH {_LASTG}, {_agg(by)}, {_COMBINED}, p AS (SELECT {ks}min_cluster_size::DOUBLE AS x, mean AS score, std, n, n_clusters_mean AS k, {y} AS y FROM cb WHERE mean IS NOT NULL),
     sm AS (SELECT *, {ys} AS ys FROM p WINDOW f AS ({p} ORDER BY x ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING)),
     l AS (SELECT *, x - lag(x) OVER w AS hd, lead(x) OVER w - x AS hs, lag(ys) OVER w AS y0, lead(ys) OVER w AS y2 FROM sm WINDOW w AS ({p} ORDER BY x)),
     gd AS (SELECT *, CASE WHEN hd IS NOT NULL AND hs IS NOT NULL THEN (hd*hd*y2 + (hs*hs - hd*hd)*ys - hs*hs*y0) / (hd*hs*(hd+hs)) WHEN hs IS NOT NULL THEN (y2 - ys)/hs WHEN hd IS NOT NULL THEN (ys - y0)/hd END AS dy FROM l),
     fl AS (SELECT *, ys >= min(ys) OVER v + 0.92 * (max(ys) OVER v - min(ys) OVER v) AND abs(dy) <= 0.12 * CASE WHEN max(abs(dy)) OVER v > 0 THEN max(abs(dy)) OVER v ELSE 1 END AS flat FROM gd WINDOW v AS ({p})),
     rk AS (SELECT *, row_number() OVER ({p} ORDER BY coalesce(flat, false) DESC, CASE WHEN flat THEN x END, ys DESC, x) AS r FROM fl)
     SELECT {ks}x::BIGINT AS chosen, CASE WHEN flat THEN 'plateau_derivative' ELSE 'smoothed_argmax' END AS selection, {_rs('score')}, round(k + 3e-11, 6) + 0.0 AS n_clusters FROM rk WHERE r = 1"""


_SC = _LASTG + ", sc AS (SELECT model, layer, round(avg(dbcv) + 3e-11, 6) AS score FROM g GROUP BY ALL), it AS (SELECT model || '/' || layer AS name, score, row_number() OVER (ORDER BY score DESC, model, layer) AS i FROM sc WHERE score IS NOT NULL)"
_RES = "rs AS (SELECT model, layer, chosen_min_cluster_size AS chosen FROM (SELECT model, layer, chosen_min_cluster_size, row_number() OVER (PARTITION BY model, layer ORDER BY count(*) DESC, chosen_min_cluster_size) AS r FROM {} WHERE chosen_min_cluster_size IS NOT NULL GROUP BY model, layer, chosen_min_cluster_size) WHERE r = 1)"
_ARI = """t AS (SELECT entity, cluster, count(*) AS n FROM e GROUP BY ALL), s AS (SELECT (SELECT sum(n*(n-1)/2) FROM t) AS ij, (SELECT sum(n*(n-1)/2) FROM (SELECT sum(n) AS n FROM t GROUP BY entity)) AS i,
  (SELECT sum(n*(n-1)/2) FROM (SELECT sum(n) AS n FROM t GROUP BY cluster)) AS j, (SELECT sum(n)*(sum(n)-1)/2 FROM t) AS tot), ar AS (SELECT coalesce((ij - i*j/tot) / nullif((i+j)/2 - i*j/tot, 0), 0) AS ari FROM s)"""
_CURVE = Q + """, l AS (SELECT * FROM q WHERE oov_label IS NOT NULL AND pca_residual IS NOT NULL), b AS (SELECT pca_residual AS threshold, sum(oov_label) AS p, count(*) AS n FROM l GROUP BY 1),
  cv AS (SELECT threshold, sum(p) OVER w AS tp, sum(n - p) OVER w AS fp, sum(p) OVER () AS np, sum(n - p) OVER () AS nn FROM b WINDOW w AS (ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  cu AS (SELECT threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, tp / np AS tpr, fp / nn AS fpr, tp / (tp + fp) AS precision, tp / np AS recall, 2 * tp / (tp + fp + np) AS f1 FROM cv)"""
_UNIT = U + ", n AS (SELECT row_id, entity, [x / sqrt(list_sum([y * y for y in embed])) for x in embed] AS v FROM u WHERE entity IS NOT NULL)"
SQL = {
    "t3_cluster_composition": f"WITH {_MASS} SELECT cluster::BIGINT AS cluster, entity, {_rs('mass')} FROM {_top('mass', 3)}",
    "a7_composition": f"WITH {_QC}, {_COMP.format('c')} SELECT cluster::BIGINT AS cluster, entity, n, {_rs('within')}, {_rs('capture')} FROM comp",
    "a8_entity_mass": f"WITH {_MASS} SELECT cluster::BIGINT AS cluster, entity, {_rs('mass')} FROM mass",
    "a9_entity_weights": f"WITH {_QC} SELECT row_id, round(1 / sqrt(count(*) OVER (PARTITION BY entity)) + 3e-11, 6) + 0.0 AS weight FROM c",
    "a10_emergent_clusters": "SELECT count(DISTINCT cluster) AS n_clusters FROM mention_quality_frame WHERE cluster <> -1",
    "a11_mass_summary": "SELECT count(*) AS n_rows, count(DISTINCT cluster) FILTER (cluster <> -1) AS n_clusters, count(*) FILTER (cluster = -1) AS n_noise, round(count(*) FILTER (cluster = -1) / count(*) + 3e-11, 6) + 0.0 AS noise_fraction FROM mention_quality_frame WHERE cluster IS NOT NULL",
    "a12_modal_cluster": f"WITH {_QC}, {_MODAL} SELECT entity, cluster::BIGINT AS cluster FROM modal",
    "a13_provisional_assignments": f"WITH {_QC}, {_MODAL} SELECT 'id:' || entity AS entity_id, cluster::BIGINT AS cluster FROM modal",
    "a31_emergent_catalogue": f"""WITH {_MASS}, {_COMP.format('c')}, t AS (SELECT cluster, sum(mass) AS weighted_mass FROM mass GROUP BY 1), r AS (SELECT *, max(within) OVER w AS dominant_fraction, sum(n) OVER w AS mention_count, row_number() OVER (PARTITION BY cluster ORDER BY within DESC, entity) AS rank FROM comp WHERE cluster <> -1 WINDOW w AS (PARTITION BY cluster))
       SELECT cluster::BIGINT AS cluster, {_rs('weighted_mass')}, mention_count::BIGINT AS mention_count, {_rs('dominant_fraction')}, rank, entity, {_rs('within')}, {_rs('capture')} FROM r JOIN t USING (cluster) WHERE rank <= 5""",
    "t1_top_clusters": f"WITH {_MASS} SELECT cluster::BIGINT AS cluster, round(sum(mass) + 3e-11, 6) + 0.0 AS total FROM mass GROUP BY 1 ORDER BY round(sum(mass), 9) DESC, cluster LIMIT 10",
    "t2_limit_flow": f"""WITH {_MASS}, tb AS {_top('mass', 4)}, tc AS (SELECT cluster FROM tb GROUP BY 1 ORDER BY round(sum(mass), 9) DESC, cluster LIMIT 12), kp AS (SELECT * FROM tb WHERE cluster IN (FROM tc)),
       te AS (SELECT entity FROM kp WHERE entity NOT LIKE 'Other (%' GROUP BY 1 ORDER BY round(sum(mass), 9) DESC, entity LIMIT 9) SELECT cluster::BIGINT AS cluster, entity, {_rs('mass')} FROM kp WHERE entity LIKE 'Other (%' OR entity IN (FROM te)""",
    "w2_top_n_and_other": f"WITH {_QC}, mass AS (SELECT cluster, entity, count(*)::DOUBLE AS mass FROM e GROUP BY ALL) SELECT cluster::BIGINT AS cluster, entity, {_rs('mass')} FROM {_top('mass', 5)}",
    "proj8_emergent_rows": "SELECT quality_id AS row_id, cluster::BIGINT AS cluster FROM mention_quality_frame WHERE cluster <> -1",
    "s16_consensus_names": f"""WITH {_QC}, z AS (SELECT * FROM c WHERE entity <> '{NEG}'), {_COMP.format('z')}, a AS (SELECT cluster, count(*) AS k, max(within) AS mx, min(within) AS mn, string_agg(entity, '-' ORDER BY entity) AS j,
       arg_min(entity, (-within, entity)) AS first, list(within ORDER BY within DESC) AS f FROM comp GROUP BY 1), b AS (SELECT cluster, CASE WHEN cluster = -1 THEN 'noise' WHEN k = 1 THEN first WHEN mx - mn <= least(0.15, 0.5 / k) THEN j WHEN mx >= 0.52 AND mx - coalesce(f[2], 0) >= 0.12 THEN first ELSE j END AS name FROM a)
       SELECT cluster::BIGINT AS cluster, CASE WHEN count(*) OVER (PARTITION BY name) > 1 THEN name || '_' || chr((64 + row_number() OVER (PARTITION BY name ORDER BY cluster))::INT) ELSE name END AS name FROM b""",
    "s17_derived_labels": f"""WITH {_QC}, {_MODAL}, {_COMP.format('c')}, t AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY within DESC, entity) AS r FROM comp), nm AS (SELECT cluster, CASE WHEN cluster = -1 THEN 'noise' ELSE string_agg(entity, ' / ' ORDER BY r) END AS name FROM t WHERE r <= 3 AND (within >= 0.05 OR r = 1) GROUP BY 1)
       SELECT 'id:' || entity AS entity_id, name FROM modal JOIN nm USING (cluster)""",
    "a14_aggregate_grid": f"WITH {_LASTG}, {_agg([])} SELECT min_cluster_size::BIGINT AS min_cluster_size, {', '.join(_rs(f'{m}_{k}') for m in ('dbcv', 'ari') for k in ('mean', 'std'))}, dbcv_count, ari_count, {_rs('icm_mean')}, {_rs('n_clusters_mean')} FROM ag",
    "a20_search_summary": f"""WITH {_LASTG}, p AS (SELECT model, layer, sample_idx, max(chosen_min_cluster_size) AS size, coalesce(max(dbcv) FILTER (min_cluster_size = 45), max(dbcv)) AS score, avg(ari) AS ari FROM g GROUP BY ALL)
       SELECT model, layer, {', '.join(f'round({f}({c}) + 3e-11, 6) + 0.0 AS {c}_{k}' for c in ('size', 'score', 'ari') for f, k in (('avg', 'mean'), ('stddev_pop', 'std')))} FROM p GROUP BY ALL""",
    "a21_clusters_at": f"WITH {_LASTG} SELECT model, layer, max(n_clusters)::BIGINT AS n_clusters FROM g WHERE min_cluster_size = 30 GROUP BY ALL",
    "a22_resolved_size": f"WITH {_LASTG}, {_RES.format('g')} SELECT model, layer, chosen::BIGINT AS chosen FROM rs",
    "a19_pooled_metrics": f"""WITH {_LASTG}, x AS (SELECT *, CASE WHEN n_clusters > 30 THEN 'many' ELSE 'few' END AS kind FROM g), kd AS (SELECT model, layer, kind FROM (SELECT model, layer, kind, row_number() OVER (PARTITION BY model, layer ORDER BY count(*) DESC, kind) AS r FROM x GROUP BY model, layer, kind) WHERE r = 1)
       SELECT model, layer, {', '.join(f'round(coalesce({f}({m}), {z}) + 3e-11, 6) + 0.0 AS {m}_{k}' for m in ('dbcv', 'ari') for f, k, z in (('avg', 'mean', 'NULL'), ('stddev_samp', 'std', '0')))}, any_value(kd.kind) AS kind FROM x JOIN kd USING (model, layer) GROUP BY model, layer""",
    "a23_leaderboard": f"WITH {_SC}, p AS (SELECT * FROM sc WHERE NOT contains(model, '+') QUALIFY row_number() OVER (PARTITION BY model ORDER BY score DESC, layer) = 1) SELECT model, layer, score, row_number() OVER (ORDER BY score DESC, model) = 1 AS overall FROM p",
    "w3_smoothed": f"WITH {_LASTG}, {_agg(gr.COMBO)} SELECT model, layer, min_cluster_size::BIGINT AS min_cluster_size, round(avg(dbcv_mean) OVER (PARTITION BY model, layer ORDER BY min_cluster_size ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) + 3e-11, 6) + 0.0 AS y_smooth FROM ag",
    "w4_weighted_smooth": f"WITH {_LASTG}, {_agg(gr.COMBO)} SELECT model, layer, min_cluster_size::BIGINT AS min_cluster_size, round(sum(dbcv_count * dbcv_mean) OVER f / sum(dbcv_count) OVER f + 3e-11, 6) + 0.0 AS y_smooth FROM ag WHERE dbcv_mean IS NOT NULL WINDOW f AS (PARTITION BY model, layer ORDER BY min_cluster_size ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)",
    "w5_gradient": f"""WITH g0 AS (SELECT * FROM grid_export QUALIFY row_number() OVER (PARTITION BY model, layer, sample_idx, min_cluster_size ORDER BY ingested_at DESC, icm DESC NULLS LAST) = 1), g AS (SELECT * FROM g0 WHERE min_cluster_size <> 25), {_agg(gr.COMBO)},
       l AS (SELECT model, layer, min_cluster_size, dbcv_mean AS y, min_cluster_size - lag(min_cluster_size) OVER w AS hd, lead(min_cluster_size) OVER w - min_cluster_size AS hs, lag(dbcv_mean) OVER w AS y0, lead(dbcv_mean) OVER w AS y2 FROM ag WINDOW w AS (PARTITION BY model, layer ORDER BY min_cluster_size))
       SELECT model, layer, min_cluster_size::BIGINT AS min_cluster_size, round(CASE WHEN hd IS NOT NULL AND hs IS NOT NULL THEN (hd*hd*y2 + (hs*hs - hd*hd)*y - hs*hs*y0) / (hd*hs*(hd+hs)) WHEN hs IS NOT NULL THEN (y2 - y)/hs WHEN hd IS NOT NULL THEN (y - y0)/hd END + 3e-11, 6) + 0.0 AS dy FROM l""",
    "w6_min_max_curve": f"WITH {_LASTG}, {_agg(gr.COMBO)} SELECT model, layer, min_cluster_size::BIGINT AS min_cluster_size, round(CASE WHEN max(dbcv_mean) OVER w > min(dbcv_mean) OVER w THEN (dbcv_mean - min(dbcv_mean) OVER w) / (max(dbcv_mean) OVER w - min(dbcv_mean) OVER w) WHEN dbcv_mean IS NOT NULL THEN 1 END + 3e-11, 6) + 0.0 AS y FROM ag WINDOW w AS (PARTITION BY model, layer)",
    "w7_min_max_fold": f"WITH {Q}, v AS (SELECT model, layer, avg(pca_residual) AS v FROM q GROUP BY ALL) SELECT model, layer, round(CASE WHEN max(v) OVER w > min(v) OVER w THEN (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) WHEN v IS NOT NULL THEN 0.5 END + 3e-11, 6) + 0.0 AS y FROM v WINDOW w AS (PARTITION BY model)",
    "w16_points_at_chosen": f"WITH {_LASTG}, {_RES.format('g')} SELECT model, layer, sample_idx::BIGINT AS sample_idx, min_cluster_size::BIGINT AS min_cluster_size, round(ari + 3e-11, 6) + 0.0 AS ari FROM g JOIN rs USING (model, layer) WHERE min_cluster_size = chosen AND n_clusters > 1 AND ari IS NOT NULL QUALIFY row_number() OVER (PARTITION BY model, layer, sample_idx ORDER BY ingested_at DESC, ari DESC) = 1",
    "m19_combined_objective": f"WITH {_LASTG}, {_agg(gr.COMBO)}, {_COMBINED} SELECT model, layer, min_cluster_size::BIGINT AS min_cluster_size, {_rs('mean')}, {_rs('std')}, n, round(n / (std * std + 1e-8) + 3e-11, 3) + 0.0 AS w, round(0.2 * ln(greatest(n_clusters_mean, 1) / 20) + 3e-11, 6) + 0.0 AS reward FROM cb",
    "m21_solve_sizes": _solve(gr.COMBO, 1, "mean", None),
    "m22_solve_pooled": _solve([], 2, "mean", None),
    "m22_solve_lower_bound": _solve(gr.COMBO, 1, "mean - 0.5 * coalesce(std, 0)", "(n / (std * std + 1e-8))"),
    "m23_apply_chosen": f"WITH {_LASTG}, one AS (SELECT * FROM g WHERE layer = '1'), {_RES.format('one')} SELECT model, layer, sample_idx::BIGINT AS sample_idx, min_cluster_size::BIGINT AS min_cluster_size, coalesce(chosen, chosen_min_cluster_size)::BIGINT AS chosen_min_cluster_size FROM g LEFT JOIN rs USING (model, layer)",
    "m25_scaled_flow": f"WITH {_MASS}, tb AS {_top('mass', 3)}, sm AS (SELECT min(t) AS t FROM (SELECT sum(mass) AS t FROM tb GROUP BY cluster UNION ALL SELECT sum(mass) FROM tb GROUP BY entity) WHERE t > 0) SELECT cluster::VARCHAR AS cluster, entity, round(mass * greatest(1, 5.0 / t) + 3e-11, 6) + 0.0 AS mass FROM tb, sm",
    "t4_ranked_entries": f"WITH {_SC} SELECT model, layer, score, row_number() OVER (ORDER BY score DESC, model, layer) AS rank FROM sc WHERE score IS NOT NULL ORDER BY rank LIMIT 3",
    "t7_fusion_pairs": f"WITH {_SC} SELECT least(a.name, b.name) || '+' || greatest(a.name, b.name) AS members, round(a.score + b.score + 3e-11, 6) + 0.0 AS score FROM it a, it b WHERE a.i < b.i ORDER BY round(a.score + b.score, 9) DESC, a.i, b.i LIMIT 5",
    "t7_fusion_triples": f"WITH {_SC} SELECT array_to_string(list_sort([a.name, b.name, c.name]), '+') AS members, round(a.score + b.score + c.score + 3e-11, 6) + 0.0 AS score FROM it a, it b, it c WHERE a.i < b.i AND b.i < c.i ORDER BY round(a.score + b.score + c.score, 9) DESC, a.i, b.i, c.i LIMIT 4",
    "o6_pivot_scores": f"WITH {_SC} SELECT model, max(score) FILTER (layer = '1') AS one, max(score) FILTER (layer = '1,2,3') AS three FROM sc WHERE layer IN ('1', '1,2,3') GROUP BY 1",
    "a16_adjusted_rand": f"WITH {Q}, e AS (SELECT * FROM q WHERE cluster <> -1 AND entity IS NOT NULL), {_ARI} SELECT {_rs('ari')} FROM ar",
    "a17_fit_metrics": f"WITH {_QC}, {_ARI} SELECT count(DISTINCT cluster) FILTER (cluster <> -1) AS n_clusters, round(count(*) FILTER (cluster = -1) / count(*) + 3e-11, 6) + 0.0 AS noise_fraction, (SELECT round(ari + 3e-11, 6) + 0.0 FROM ar) AS ari FROM c",
    "a18_mean_cosine": f"WITH {_UNIT}, s AS (SELECT entity, pos, sum(x) AS s, count(*) AS n FROM (SELECT entity, unnest(v) AS x, unnest(range(64)) AS pos FROM n) GROUP BY ALL) SELECT entity, max(n) AS n, round((sum(s*s) - max(n)) / (max(n) * (max(n) - 1)) + 3e-11, 6) + 0.0 AS mean_cosine FROM s GROUP BY 1 HAVING max(n) > 1",
    "a18_cosine_deviation": f"WITH {_UNIT}, x AS (FROM n) SELECT a.entity, count(*) AS n_pairs, round(stddev_samp(list_inner_product(a.v, b.v)) + 3e-11, 6) + 0.0 AS std FROM x a JOIN x b ON a.entity = b.entity AND a.row_id < b.row_id GROUP BY 1",
    "a24_metric_quantiles": f"WITH {Q} " + " UNION ALL ".join(f"SELECT '{m}' AS metric, {p}::DOUBLE AS q, round(quantile_cont({m}, {p}) + 3e-11, 6) + 0.0 AS value FROM q" for m in METRICS for p in (0.5, 0.9, 0.95, 0.99)),
    "a25_medians_by_class": f"WITH {Q} SELECT oov_label, {', '.join(f'round(median({m}) + 3e-11, 6) + 0.0 AS {m}' for m in METRICS)} FROM q WHERE oov_label IS NOT NULL GROUP BY 1",
    "a26_spearman": f"WITH {Q}, b AS (SELECT pca_residual AS x, pca_mahalanobis AS y FROM q WHERE pca_residual IS NOT NULL AND pca_mahalanobis IS NOT NULL), r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM b) SELECT round(corr(rx, ry) + 3e-11, 6) + 0.0 AS rho FROM r",
    "a27_ellipses": f"WITH {_LASTG}, v AS (SELECT model, layer, avg(dbcv) AS mx, avg(ari) AS my, var_samp(dbcv) AS vx, var_samp(ari) AS vy, covar_samp(dbcv, ari) AS covariance FROM g GROUP BY ALL), w AS (SELECT *, (vx + vy) / 2 AS mid, sqrt(pow((vx - vy) / 2, 2) + covariance * covariance) AS h FROM v) SELECT model, layer, {_rs('mx')}, {_rs('my')}, {_rs('covariance')}, round(sqrt(5.991464547107979 * greatest(mid + h, 0)) + 3e-11, 6) + 0.0 AS major, round(sqrt(5.991464547107979 * greatest(mid - h, 0)) + 3e-11, 6) + 0.0 AS minor FROM w",
    "w8_z_scores": f"WITH {Q}, z AS (SELECT row_id, {', '.join(f'CASE WHEN stddev_pop({m}) OVER w > 1e-12 THEN ({m} - avg({m}) OVER w) / stddev_pop({m}) OVER w WHEN {m} IS NOT NULL THEN 0 END AS z_{m}' for m in METRICS)} FROM q WINDOW w AS (PARTITION BY model, layer)) SELECT row_id, {', '.join(_rs(f'z_{m}') for m in METRICS)}, round(greatest({', '.join(f'z_{m}' for m in METRICS)}) + 3e-11, 6) + 0.0 AS max_z FROM z",
    "w17_roc_pr_curve": f"WITH {_CURVE} SELECT threshold, tp, fp, {', '.join(map(_rs, ('tpr', 'fpr', 'precision', 'f1')))} FROM cu",
    "w17_average_precision": f"WITH {_CURVE}, st AS (SELECT (recall - coalesce(lag(recall) OVER (ORDER BY threshold DESC), 0)) * precision AS x FROM cu) SELECT round(sum(x) + 3e-11, 6) + 0.0 AS average_precision FROM st",
    "w18_auc": f"WITH {Q}, l AS (SELECT oov_label AS y, rank() OVER (ORDER BY pca_mahalanobis) + (count(*) OVER (PARTITION BY pca_mahalanobis) - 1) / 2 AS r FROM q WHERE oov_label IS NOT NULL AND pca_mahalanobis IS NOT NULL) SELECT round((sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) + 3e-11, 6) + 0.0 AS auc FROM l",
    "w19_best_f1": f"WITH {_CURVE} SELECT threshold, {_rs('f1')} FROM cu ORDER BY round(cu.f1, 9) DESC, threshold LIMIT 1",
    "e12_binary_metrics": f"""WITH {Q}, k AS (SELECT model, layer, count(*) FILTER (oov_label = 1 AND pca_residual > 0.8) AS tp, count(*) FILTER (oov_label <> 1 AND pca_residual > 0.8) AS fp, count(*) FILTER (oov_label = 1 AND pca_residual <= 0.8) AS fn FROM q WHERE oov_label IS NOT NULL GROUP BY ALL)
       SELECT model, layer, round(coalesce(tp / nullif(tp + fp, 0), 0) + 3e-11, 6) + 0.0 AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0) + 3e-11, 6) + 0.0 AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) + 3e-11, 6) + 0.0 AS f1 FROM k""",
    "m24_operating_points": f"""WITH {Q}, i AS (SELECT unnest(range(120)) AS point), t AS (SELECT point, -7 + point * (16.0::DOUBLE / 119) AS intercept FROM i), x AS (SELECT point, intercept, count(*) FILTER (2 * pca_residual + intercept - pca_mahalanobis > 0) AS said, count(*) FILTER (2 * pca_residual + intercept - pca_mahalanobis > 0 AND oov_label = 1) AS tp, count(*) FILTER (oov_label = 1) AS np
       FROM t CROSS JOIN (SELECT * FROM q WHERE oov_label IS NOT NULL AND pca_residual IS NOT NULL AND pca_mahalanobis IS NOT NULL) GROUP BY ALL) SELECT point, {_rs('intercept')}, round(coalesce(tp / nullif(said, 0), 0) + 3e-11, 6) + 0.0 AS precision, round(coalesce(tp / nullif(np, 0), 0) + 3e-11, 6) + 0.0 AS recall, round(coalesce(2 * tp / nullif(said + np, 0), 0) + 3e-11, 6) + 0.0 AS f1 FROM x""",
    "proj20_signed_distance": f"WITH {Q} SELECT row_id, round(3.0 * pca_residual + 1.0 - pca_mahalanobis + 3e-11, 6) + 0.0 AS x FROM q",
}
