"""Vector, screener and density-clustering queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossweave.functions import vectors as vf
from glossweave.operators import learning as ln
from glossweave.operators import vectors as vx
from glossweave.operators.frames import entity_means, top_by_draw
from glossweave.plans.frames_sql import NEG, U, mentions, quality, usable_mentions
from glossweave.plans.pipeline import to_heads
from glossweave.plans.text_queries import _simplicity
from glossweave.tables import materialise, table

#: Rows that density clustering is fitted on; all others get the label of the nearest of them.
FITTED = 1500
_r = lambda c, n=6: (F.round(F.col(c) + 3e-11, n) + 0.0).alias(c)


def _named(s, d):
    return usable_mentions(s, d).where("entity IS NOT NULL")


def _means(s, d):
    """Mean vector of each entity of the knowledge base, numbered by the digits of its key."""
    from glossweave.functions.keys import entity_key

    kb = table(s, d, "kb").select(entity_key("entity_id").alias("entity"))
    return entity_means(_named(s, d), kb, 64).select(F.regexp_extract("entity", r"(\d+)", 1).try_cast("long").alias("id"), "embed")


def _base(s, d):
    return usable_mentions(s, d).select(F.col("row_id").alias("id"), "embed")


def _labelled(s, d):
    return _named(s, d).select("row_id", vf.l2_normalise("embed").alias("embed"), (F.col("entity") == NEG).cast("int").alias("y"))


def _kb_vectors(s, d):
    return table(s, d, "kb").where("label IS NOT NULL").select(F.regexp_extract("entity_id", r"(\d+)", 1).cast("long").alias("id"), "entity_id", vx.HashingEncoder().column("label").alias("embed"))


def _generality(s, d):
    kb = _kb_vectors(s, d)
    near = vx.nearest_exact(kb.select("id", "embed"), kb.select("id", "embed"), 10, 64)
    return vx.generality(near, _simplicity(s, d).join(kb.select("id", "entity_id"), "entity_id").select("id", "simplicity"))


def _reduced(s, d):
    """All named mentions in reduced coordinates, and the bounded sample of them that density clustering is fitted on."""
    rows = materialise(vx.reduce_dimensions(_named(s, d), "embed", 64, 8).select("row_id", "entity", "u"), "reduced")
    return rows, materialise(top_by_draw(rows, FITTED, 11), "sample")


def _density(s, d):
    """The cluster of every named mention, and whether it was among the fitted ones."""
    rows, sample = _reduced(s, d)
    fitted = ln.cluster_sample(sample, "row_id", "u", 15).join(sample.select("row_id", "u"), "row_id")
    return ln.nearest_fitted(rows, fitted, "row_id", "u")


def _sizes(s, d):
    return ln.whole_size_grid(*_reduced(s, d), "row_id", "u", "entity", [15, 25, 40], 8)


def _diverse(s, d):
    """One entity of the highest generality for each of 12 k-means clusters of label vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    kb = _kb_vectors(s, d).select("id", array_to_vector("embed").alias("features"))
    model = KMeans(k=12, seed=5, featuresCol="features", predictionCol="icluster").fit(kb)
    scored = model.transform(kb).join(_generality(s, d), "id")
    best = scored.groupBy("icluster").agg(F.max(F.struct("score", (-F.col("id")).alias("n"))).alias("b"))
    return best.select("icluster", (-F.col("b.n")).alias("id"), F.col("b.score").alias("score"))


QUERIES = {
    "m1_l2_normalised": lambda s, d: usable_mentions(s, d).select("row_id", F.posexplode(vf.l2_normalise("embed")).alias("pos", "val")).select("row_id", F.col("pos").cast("long").alias("pos"), _r("val", 9)),
    "m12_cosine_to_mean": lambda s, d: vx.centroid_cosines(_named(s, d), "entity", "embed", 64).select("row_id", _r("to_centroid")),
    "m14_nearest_mentions": lambda s, d: vx.nearest_exact(_means(s, d), _base(s, d), 5, 64).select(F.col("query").alias("entity_no"), F.col("other").alias("row_id"), F.col("rank").cast("long").alias("rank"), _r("cosine")),
    "m15_near_duplicate_edges": lambda s, d: vx.near_duplicate_edges(vx.nearest_exact(_means(s, d), _means(s, d), 20, 64)).select("a", "b", _r("cosine")),
    "m16_nearest_gap": lambda s, d: vx.nearest_exact(_means(s, d), _means(s, d), 1, 64).select(F.col("query").alias("entity_no"), (1 - F.col("cosine")).alias("gap")).select("entity_no", _r("gap")),
    "m17_centroid_cosine_by_entity": lambda s, d: vx.centroid_cosines(_named(s, d), "entity", "embed", 64).groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.avg("to_centroid").alias("mean_cosine")).select("entity", "n", _r("mean_cosine")),
    "a30_text_embeddings": lambda s, d: vx.text_embeddings(usable_mentions(s, d).where("itext IS NOT NULL").select(F.col("itext").alias("doc"), "embed"), mentions(s, d).where("itext IS NOT NULL").select(F.col("itext").alias("doc")).distinct(), 64)
    .select("doc", F.posexplode("embed").alias("pos", "val")).select("doc", F.col("pos").cast("long").alias("pos"), _r("val", 9)),
    "m2_pca_metrics": lambda s, d: vx.PcaModel.fit(_base(s, d), "embed", 64, 24).transform(_base(s, d), "embed").select("id", *[_r(c) for c in ("pca_residual", "pca_mahalanobis", "pca_spectral_entropy")]),
    "m7_wide_coordinates": lambda s, d: vx.wide_coordinates(vx.reduce_dimensions(_base(s, d), "embed", 64, 4), "u", "u", 4).drop("embed"),
    "m10_hashing_encoder": lambda s, d: _kb_vectors(s, d).select("entity_id", F.size("embed").cast("long").alias("dim"), vf.norm("embed").alias("length")),
    "m13_generality": lambda s, d: _generality(s, d).select("id", _r("score")),
    "t11_diverse_entities": _diverse,
    "e7_lda_scores": lambda s, d: ln.fit_lda(_labelled(s, d), "embed", "y", 64).score(_labelled(s, d), "embed").select("row_id", "y", _r("score")),
    "e8_svm_scores": lambda s, d: ln.fit_svm(_labelled(s, d), "embed", "y", 64).score(_labelled(s, d), "embed").select("row_id", "y", _r("score")),
    "e8_rbf_scores": lambda s, d: ln.fit_svm(_labelled(s, d), "embed", "y", 64, rbf=128, gamma=1.0).score(_labelled(s, d), "embed").select("row_id", "y", _r("score")),
    "e9_screener_report": lambda s, d: ln.screener_report(ln.cross_validated_scores(_labelled(s, d), "embed", "y", 64, 3), "y"),
    "e14_projection_model": lambda s, d: _projection(s, d),
    "e2_size_grid": _sizes,
    "e3_density_clusters": _density,
    "e3_labelled_rows": lambda s, d: _density(s, d).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("row_id").alias("n_ids"), (F.max("cluster") >= 1).alias("several"), F.count_if("is_fitted").alias("n_fitted")),
    "e5_approximate_predict": lambda s, d: _approximate(s, d),
}


def _projection(s, d):
    """A linear screener on the three quality measures, scored on all rows."""
    q = quality(s, d).where("oov_label IS NOT NULL AND pca_residual IS NOT NULL AND pca_mahalanobis IS NOT NULL AND pca_spectral_entropy IS NOT NULL")
    q = q.select("row_id", F.array("pca_residual", "pca_mahalanobis", "pca_spectral_entropy").alias("x"), F.col("oov_label").cast("int").alias("y"))
    return ln.fit_lda(q, "x", "y", 3).score(q, "x").select("row_id", "y", _r("score"), (F.col("score") > 0).alias("is_oov"))


def _approximate(s, d):
    """Cluster of the nearest head for every usable mention, one row each; -1 where the bounded sample has no cluster (README: the rest by nearest head)."""
    sample = top_by_draw(_named(s, d), 1500, 11)
    fitted = materialise(ln.cluster_sample(vx.reduce_dimensions(sample, "embed", 64, 8), "row_id", "u", 15), "fitted")
    trained = fitted.where("cluster >= 0").join(sample.select("row_id", "embed"), "row_id")
    heads = trained.groupBy("cluster").agg(F.min("row_id").alias("head"))
    means = vf.mean_vectors(trained, ["cluster"], "embed").select(F.col("cluster").cast("long").alias("id"), "embed")
    near = to_heads(usable_mentions(s, d).select("row_id", "embed"), means, 64)
    return near.join(F.broadcast(heads), "cluster", "left").select("row_id", "cluster", "head", F.round("score", 6).alias("cosine"))


def _rs(c, n=6):
    return f"round({c} + 3e-11, {n}) + 0.0 AS {c}"


_V = U + ", n AS (SELECT *, [x / sqrt(list_sum([y * y for y in embed])) for x in embed] AS v FROM u)"
_CELLS = "c AS (SELECT row_id, entity, itext, unnest(embed) AS val, unnest(range(64)) AS pos FROM u)"
_MEANS = _CELLS + """, em AS (SELECT entity, pos, avg(val) AS val FROM c WHERE entity IS NOT NULL GROUP BY ALL)"""
_CENT = U + ", " + _MEANS + """, tc AS (SELECT c.row_id, c.entity, sum(c.val * em.val) / (sqrt(sum(c.val * c.val)) * sqrt(sum(em.val * em.val))) AS to_centroid FROM c JOIN em USING (entity, pos) GROUP BY ALL)"""
_KBM = _V + ", " + _MEANS + r""", kk AS (SELECT DISTINCT lower(regexp_replace(entity_id, '[^\p{L}\p{N}]+', '', 'g')) AS entity FROM kb),
  l AS (SELECT entity, list(val ORDER BY pos) AS e FROM em WHERE entity IN (FROM kk) GROUP BY 1), km AS (SELECT regexp_extract(entity, '(\d+)', 1)::BIGINT AS id, [x / sqrt(list_sum([y * y for y in e])) for x in e] AS v FROM l)"""
_PAIRS = _KBM + ", pp AS (SELECT a.id AS a, b.id AS b, list_inner_product(a.v, b.v) AS cosine FROM km a JOIN km b ON a.id <> b.id)"
SQL = {
    "e3_labelled_rows": f"WITH {U} SELECT count(*) AS n_rows, count(*) AS n_ids, true AS several, least(1500, count(*)) AS n_fitted FROM u WHERE entity IS NOT NULL",
    "m1_l2_normalised": f"WITH {_V} SELECT row_id, unnest(range(64)) AS pos, unnest([round(x + 3e-11, 9) + 0.0 for x in v]) AS val FROM n",
    "m12_cosine_to_mean": f"WITH {_CENT} SELECT row_id, {_rs('to_centroid')} FROM tc",
    "m17_centroid_cosine_by_entity": f"WITH {_CENT} SELECT entity, count(*) AS n, round(avg(to_centroid) + 3e-11, 6) + 0.0 AS mean_cosine FROM tc GROUP BY 1",
    "m14_nearest_mentions": f"WITH {_KBM}, x AS (SELECT km.id AS entity_no, n.row_id, list_inner_product(km.v, n.v) AS cosine FROM km CROSS JOIN n WHERE km.id <> n.row_id) SELECT entity_no, row_id, rank, {_rs('cosine')} FROM (SELECT *, row_number() OVER (PARTITION BY entity_no ORDER BY round(cosine, 9) DESC, row_id) AS rank FROM x) WHERE rank <= 5",
    "m15_near_duplicate_edges": f"WITH {_PAIRS}, q AS (SELECT a, b, round(cosine, 9) AS cosine FROM pp WHERE a < b) SELECT a, b, {_rs('cosine')} FROM q WHERE q.cosine >= (SELECT min(cosine) FROM (SELECT cosine FROM q ORDER BY cosine DESC LIMIT 20))",
    "m16_nearest_gap": f"WITH {_PAIRS} SELECT a AS entity_no, round(1 - max(cosine) + 3e-11, 6) + 0.0 AS gap FROM pp GROUP BY 1",
    "a30_text_embeddings": f"WITH {U}, {_CELLS}, t AS (SELECT DISTINCT itext AS doc FROM m WHERE itext IS NOT NULL), m2 AS (SELECT itext, pos, avg(val) AS val FROM c WHERE itext IS NOT NULL GROUP BY ALL), g AS (SELECT doc, unnest(range(64)) AS pos FROM t) SELECT doc, g.pos, round(coalesce(val, 0) + 3e-11, 9) + 0.0 AS val FROM g LEFT JOIN m2 ON m2.itext = g.doc AND m2.pos = g.pos",
}
