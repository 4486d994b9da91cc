"""Scans, joins, means, samples and upserts over the mention tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossweave.operators import frames as op
from glossweave.plans.frames_sql import KB, NEG, M, Q, U, draw_sql, grid, knowledge_base, mentions, quality, usable_mentions
from glossweave.schema import KEYS
from glossweave.sources.readers import texts_of
from glossweave.tables import table

_KEYS = ", ".join(KEYS)


def _long(df, keys):
    """Vectors as (key, pos, value) rows, rounded off the halves, without negative zeros."""
    return df.select(*keys, F.posexplode("embed").alias("pos", "val")).select(*keys, F.col("pos").cast("long").alias("pos"), (F.round(F.col("val").cast("double") + 3e-11, 9) + 0.0).alias("val"))


def _sources(s, d):
    """Two sources of one corpus: all usable mentions, and three quarters of them with halved vectors."""
    u = usable_mentions(s, d)
    return [u, u.where("row_id % 4 <> 0").withColumn("embed", F.transform("embed", lambda x: x / 2))]


def _mean_sql(src, keys):
    ks = ", ".join(keys)
    nn = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    return f"SELECT {ks}, pos, avg(val) AS val FROM (SELECT {ks}, unnest(embed) AS val, unnest(range(64)) AS pos FROM {src} WHERE {nn}) GROUP BY ALL"


def _first_sql(c):
    return f"arg_min({c}, row_id) FILTER ({c} IS NOT NULL) AS {c}"


QUERIES = {
    "r3_column_pruned_scan": lambda s, d: table(s, d, "mention_frame").where("itext >= 100").select("mention_id", "mention"),
    "r12_semi_join_texts": lambda s, d: texts_of(table(s, d, "link").where("pmid IS NOT NULL AND text IS NOT NULL"), table(s, d, "documents").where("lang = 'de'").select("pmid"), "link_id"),
    "r30_labels_map": lambda s, d: op.labels_map(knowledge_base(s, d)),
    "r31_selected_labels": lambda s, d: table(s, d, "kb").select("label").where("label IS NOT NULL").distinct(),
    "a1_mean_by_keys": lambda s, d: _long(op.mean_by_keys(usable_mentions(s, d), dim=64), KEYS),
    "a1_first_provenance": lambda s, d: op.mean_by_keys(usable_mentions(s, d), dim=64).drop("embed"),
    "a2_entity_means": lambda s, d: _long(op.entity_means(usable_mentions(s, d), dim=64), ["entity"]),
    "a6_drop_rare": lambda s, d: op.drop_rare(quality(s, d), 20, NEG).select("row_id", "entity"),
    "j1_fuse_sources": lambda s, d: _long(op.fuse(_sources(s, d), dim=64).withColumn("embed", F.transform("embed", lambda x: F.round(x.cast("double"), 4))), KEYS),
    "j1_fused_provenance": lambda s, d: op.fuse(_sources(s, d), dim=64).drop("embed"),
    "j3_fuse_entities": lambda s, d: _long(op.fuse_entities(_sources(s, d), dim=64), ["entity"]),
    "j4_first_id_by_label": lambda s, d: op.first_id_by_label(knowledge_base(s, d)),
    "j5_keep_entities": lambda s, d: op.keep_entities(quality(s, d), _kb_keys(s, d)).select("row_id", "entity"),
    "j6_drop_entities": lambda s, d: op.drop_entities(quality(s, d), _kb_keys(s, d)).select("row_id", "entity"),
    "j8_one_sample_per_combo": lambda s, d: op.one_sample_per_combo(quality(s, d)).select("row_id", "model", "layer", F.col("sample_idx").cast("long").alias("sample_idx")),
    "w1_cap_per_entity": lambda s, d: op.cap_per_entity(quality(s, d), 10, NEG, 25, seed=3).select("row_id", "entity"),
    "w15_number_entities": lambda s, d: op.number_entities(knowledge_base(s, d).withColumn("entity_id", F.when(F.col("src") == 0, F.col("entity_id"))).where("label IS NOT NULL"), 5001),
    "o2_common_entities": lambda s, d: mentions(s, d).select("entity").intersect(quality(s, d).select("entity")).where("entity IS NOT NULL"),
    "o4_merge_knowledge_bases": lambda s, d: op.merge_knowledge_bases(knowledge_base(s, d)).select("entity_id", "label", "description"),
    "o9_stratified_sample": lambda s, d: op.stratified_sample(quality(s, d), 500, NEG, seed=5).select("row_id"),
    "o10_bootstrap_draws": lambda s, d: op.stratified_sample(quality(s, d), 300, NEG, seed=1).select(F.lit(0).cast("long").alias("draw"), "row_id")
    .unionByName(op.stratified_sample(quality(s, d), 300, NEG, seed=2).select(F.lit(1).cast("long").alias("draw"), "row_id")),
    "o12_balanced_sample": lambda s, d: op.balanced_sample(quality(s, d).where("oov_label IS NOT NULL"), 400, "oov_label", seed=4).select("row_id", "oov_label"),
    "o15_stratified_folds": lambda s, d: op.folds(quality(s, d).where("oov_label IS NOT NULL"), "oov_label", 5, seed=9).select("row_id", "fold"),
    "o16_train_test_sizes": lambda s, d: op.folds(quality(s, d).where("oov_label IS NOT NULL"), "oov_label", 5, seed=9)
    .groupBy("fold").agg(F.count(F.lit(1)).alias("n_test"), F.sum("oov_label").alias("n_negative")),
    "o3_keep_last": lambda s, d: op.keep_last(grid(s, d), ["model", "layer", "sample_idx", "min_cluster_size"], [F.desc("ingested_at"), F.desc_nulls_last("icm")])
    .select("model", "layer", *[F.col(c).cast("long").alias(c) for c in ("sample_idx", "min_cluster_size")], "icm"),
    "k2_upsert_grid": lambda s, d: op.upsert(
        op.keep_last(grid(s, d), _PK, [F.desc("ingested_at"), F.desc_nulls_last("icm")]).where("sample_idx < 2").drop("ingested_at"),
        op.keep_last(grid(s, d), _PK, [F.desc("ingested_at"), F.desc_nulls_last("icm")]).where("sample_idx >= 1").withColumn("icm", F.col("icm") + 1).drop("ingested_at"),
        _PK,
    ).select("model", "layer", F.col("sample_idx").cast("long").alias("sample_idx"), F.col("min_cluster_size").cast("long").alias("min_cluster_size"), F.round("icm", 6).alias("icm")),
    "k3_upsert_quality": lambda s, d: op.upsert(quality(s, d).where("row_id % 3 <> 0").select("mention_id", "model", "layer", "sample_idx", F.lit("old").alias("state")).distinct(),
        quality(s, d).where("row_id % 3 = 0").select("mention_id", "model", "layer", "sample_idx", F.lit("new").alias("state")).distinct(), ["mention_id", "model", "layer", "sample_idx"])
    .groupBy("state").agg(F.count(F.lit(1)).alias("n")),
    "q1_selection_frame": lambda s, d: op.selection_frame(_sources(s, d), NEG, _kb_keys(s, d), least=5).groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.min(F.size("embed")).cast("long").alias("dim")),
    "a29_distinct_properties": lambda s, d: quality(s, d).agg(F.count_distinct("entity").alias("n_entities"), F.count_distinct("pmid").alias("n_articles")),
    "a28_class_counts": lambda s, d: quality(s, d).groupBy("oov_label").agg(F.count(F.lit(1)).alias("n")),
    "proj6_split_negative": lambda s, d: quality(s, d).groupBy(F.coalesce(F.col("entity") == NEG, F.lit(False)).alias("is_negative")).agg(F.count(F.lit(1)).alias("n")),
    "proj7_negative_mask": lambda s, d: quality(s, d).select("row_id", F.coalesce((F.col("entity") == NEG).cast("long"), F.lit(0)).alias("y")),
    "r1_table_sizes": lambda s, d: _sizes(s, d),
}
_PK = ["model", "layer", "sample_idx", "min_cluster_size"]


def _kb_keys(s, d):
    from glossweave.functions.keys import entity_key

    return table(s, d, "kb").select(entity_key("entity_id").alias("entity"))


def _sizes(s, d):
    out = None
    for t in ("mention_frame", "mention_quality_frame", "documents", "link", "kb"):
        one = table(s, d, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


_KBK = f"kk AS (SELECT DISTINCT lower(regexp_replace(entity_id, '[^\\p{{L}}\\p{{N}}]+', '', 'g')) AS entity FROM kb)"
_SRC = U + ", v AS (SELECT * REPLACE ([x / 2 for x in embed] AS embed) FROM u WHERE row_id % 4 <> 0)"
_A, _B = f"fa AS ({_mean_sql('u', KEYS)})", f"fb AS ({_mean_sql('v', KEYS)})"
_NEGC = f"(SELECT count(*) FROM q WHERE entity = '{NEG}')"


def _strat_sql(n, seed):
    return f"""SELECT row_id FROM (SELECT row_id, coalesce(entity = '{NEG}', false) AS neg, row_number() OVER (PARTITION BY coalesce(entity = '{NEG}', false) ORDER BY {draw_sql('row_id', seed)}, row_id) AS r,
      round_even({n}.0 * {_NEGC} / (SELECT count(*) FROM q), 0) AS kn FROM q) WHERE r <= CASE WHEN neg THEN kn ELSE {n} - kn END"""


_LASTG = "g AS (SELECT * FROM grid_export QUALIFY row_number() OVER (PARTITION BY model, layer, sample_idx, min_cluster_size ORDER BY ingested_at DESC, icm DESC NULLS LAST) = 1)"
_FOLD = f"f AS (SELECT row_id, oov_label, (row_number() OVER (PARTITION BY oov_label ORDER BY {draw_sql('row_id', 9)}, row_id) - 1) % 5 AS fold FROM q WHERE oov_label IS NOT NULL)"
SQL = {
    "r3_column_pruned_scan": "SELECT mention_id, mention FROM mention_frame WHERE itext >= 100",
    "r12_semi_join_texts": "SELECT pmid, arg_max(text, link_id) FILTER (true) AS text FROM (SELECT pmid, link_id, text FROM link WHERE pmid IN (SELECT pmid FROM documents WHERE lang = 'de' AND pmid IS NOT NULL) AND text IS NOT NULL) GROUP BY pmid",
    "r30_labels_map": f"WITH {KB} SELECT entity_id, arg_max(label, (ord, label)) AS label FROM k WHERE label IS NOT NULL GROUP BY entity_id",
    "r31_selected_labels": "SELECT DISTINCT label FROM kb WHERE label IS NOT NULL",
    "a1_mean_by_keys": f"WITH {U}, {_A} SELECT {_KEYS}, pos, round(val + 3e-11, 9) + 0.0 AS val FROM fa",
    "a1_first_provenance": f"WITH {U} SELECT {_KEYS}, {', '.join(map(_first_sql, ['a', 'b', 'a_abs', 'b_abs', 'itext', 'ichunk']))} FROM u WHERE pmid IS NOT NULL AND entity IS NOT NULL AND mention IS NOT NULL GROUP BY {_KEYS}",
    "a2_entity_means": f"WITH {U} SELECT entity, pos, round(val + 3e-11, 9) + 0.0 AS val FROM ({_mean_sql('u', ['entity'])})",
    "a6_drop_rare": f"WITH {Q} SELECT row_id, entity FROM q WHERE entity IS NULL OR entity = '{NEG}' OR entity IN (SELECT entity FROM q GROUP BY entity HAVING count(*) >= 20)",
    "j1_fuse_sources": f"WITH {_SRC}, {_A}, {_B}, ks AS (SELECT DISTINCT {_KEYS} FROM fa INTERSECT SELECT DISTINCT {_KEYS} FROM fb) SELECT {_KEYS}, pos, round(round(val::FLOAT::DOUBLE, 4) + 3e-11, 9) + 0.0 AS val FROM (SELECT * FROM fa UNION ALL SELECT {_KEYS}, pos + 64, val FROM fb) SEMI JOIN ks USING ({_KEYS})",
    "j1_fused_provenance": f"WITH {_SRC}, ks AS (SELECT DISTINCT {_KEYS} FROM v) SELECT {_KEYS}, {', '.join(map(_first_sql, ['a', 'b', 'a_abs', 'b_abs', 'itext', 'ichunk']))} FROM u SEMI JOIN ks USING ({_KEYS}) WHERE pmid IS NOT NULL AND entity IS NOT NULL AND mention IS NOT NULL GROUP BY {_KEYS}",
    "j3_fuse_entities": f"WITH {_SRC}, x AS ({_mean_sql('u', ['entity'])}), y AS ({_mean_sql('v', ['entity'])}) SELECT entity, pos, round(val + 3e-11, 9) + 0.0 AS val FROM (SELECT * FROM x WHERE entity IN (SELECT entity FROM y) UNION ALL SELECT entity, pos + 64, val FROM y)",
    "j4_first_id_by_label": f"WITH {KB} SELECT label, arg_min(entity_id, ord) AS entity_id FROM k WHERE label IS NOT NULL GROUP BY label",
    "j5_keep_entities": f"WITH {Q}, {_KBK} SELECT row_id, entity FROM q WHERE entity IN (SELECT entity FROM kk)",
    "j6_drop_entities": f"WITH {Q}, {_KBK} SELECT row_id, entity FROM q WHERE entity IS NULL OR entity NOT IN (SELECT entity FROM kk)",
    "j8_one_sample_per_combo": f"WITH {Q} SELECT row_id, model, layer, sample_idx::BIGINT AS sample_idx FROM q WHERE sample_idx = (SELECT min(sample_idx) FROM q p WHERE p.model = q.model AND p.layer = q.layer)",
    "w1_cap_per_entity": f"WITH {Q} SELECT row_id, entity FROM (SELECT row_id, entity, row_number() OVER (PARTITION BY entity ORDER BY {draw_sql('row_id', 3)}, row_id) AS r FROM q) WHERE entity IS NULL OR r <= CASE WHEN entity = '{NEG}' THEN 25 ELSE 10 END",
    "w15_number_entities": "SELECT label, printf('KB.%06d', 5000 + row_number() OVER (ORDER BY label)) AS entity_id FROM (SELECT DISTINCT label FROM kb_extension WHERE label IS NOT NULL)",
    "o2_common_entities": f"WITH {M}, {Q} SELECT entity FROM m WHERE entity IS NOT NULL INTERSECT SELECT entity FROM q",
    "o4_merge_knowledge_bases": f"WITH {KB}, a AS (SELECT * FROM k WHERE label IS NOT NULL AND NOT contains(label, 'not for use in curation') AND NOT contains(label, 'obsolete') QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY description NULLS LAST, label, example NULLS LAST) = 1) SELECT entity_id, label, description FROM a QUALIFY row_number() OVER (PARTITION BY label ORDER BY entity_id) = 1",
    "o9_stratified_sample": f"WITH {Q} {_strat_sql(500, 5)}",
    "o10_bootstrap_draws": f"WITH {Q} SELECT 0::BIGINT AS draw, row_id FROM ({_strat_sql(300, 1)}) UNION ALL SELECT 1, row_id FROM ({_strat_sql(300, 2)})",
    "o12_balanced_sample": f"WITH {Q} SELECT row_id, oov_label FROM (SELECT *, row_number() OVER (PARTITION BY oov_label ORDER BY {draw_sql('row_id', 4)}, row_id) AS r FROM q WHERE oov_label IS NOT NULL) WHERE r <= 200",
    "o15_stratified_folds": f"WITH {Q}, {_FOLD} SELECT row_id, fold FROM f",
    "o16_train_test_sizes": f"WITH {Q}, {_FOLD} SELECT fold, count(*) AS n_test, sum(oov_label)::BIGINT AS n_negative FROM f GROUP BY fold",
    "o3_keep_last": f"WITH {_LASTG} SELECT model, layer, sample_idx::BIGINT AS sample_idx, min_cluster_size::BIGINT AS min_cluster_size, icm FROM g",
    "k2_upsert_grid": f"WITH {_LASTG} SELECT model, layer, sample_idx::BIGINT AS sample_idx, min_cluster_size::BIGINT AS min_cluster_size, round(CASE WHEN sample_idx >= 1 THEN icm + 1 ELSE icm END, 6) AS icm FROM g",
    "k3_upsert_quality": f"WITH {Q} SELECT CASE WHEN hit THEN 'new' ELSE 'old' END AS state, count(*) AS n FROM (SELECT bool_or(row_id % 3 = 0) AS hit FROM q GROUP BY mention_id, model, layer, sample_idx) GROUP BY 1",
    "q1_selection_frame": f"WITH {_SRC}, {_KBK}, ks AS (SELECT DISTINCT {_KEYS} FROM v WHERE pmid IS NOT NULL AND entity IS NOT NULL AND mention IS NOT NULL) SELECT entity, count(*) AS n, 128::BIGINT AS dim FROM ks WHERE entity IN (SELECT entity FROM kk) GROUP BY entity HAVING count(*) >= 5",
    "a29_distinct_properties": f"WITH {Q} SELECT count(DISTINCT entity) AS n_entities, count(DISTINCT pmid) AS n_articles FROM q",
    "a28_class_counts": "SELECT oov_label, count(*) AS n FROM mention_quality_frame GROUP BY 1",
    "proj6_split_negative": f"WITH {Q} SELECT coalesce(entity = '{NEG}', false) AS is_negative, count(*) AS n FROM q GROUP BY 1",
    "proj7_negative_mask": f"WITH {Q} SELECT row_id, coalesce((entity = '{NEG}')::BIGINT, 0) AS y FROM q",
    "r1_table_sizes": " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("mention_frame", "mention_quality_frame", "documents", "link", "kb")),
}
