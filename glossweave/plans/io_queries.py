"""Round trips through files, streams and the fitting and linking drivers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from glossweave.functions.keys import entity_key
from glossweave.functions.text import lemma_key, tokens
from glossweave.functions.vectors import l2_normalise
from glossweave.operators.frames import keep_last
from glossweave.operators.grid import PK, aggregate_grid
from glossweave.operators.vectors import HashingEncoder
from glossweave.plans import pipeline as pl
from glossweave.plans.frames_sql import METRICS, Q, grid, mentions, quality, usable_mentions
from glossweave.sources.readers import with_origin
from glossweave.sources.writers import json_rows, merge_into, write_mentions
from glossweave.streaming import ingest
from glossweave.tables import shared_dir, table


def _path(s, name):
    return f"{shared_dir(s)}/glossweave/{name}-{uuid.uuid4().hex}"


def _csv(s, d):
    p = _path(s, "kb") + ".tsv"
    table(s, d, "kb").write.options(sep="\t", header=True, quote='"', escape='"', nullValue="").csv(p)
    return s.read.options(sep="\t", header=True, multiLine=True, quote='"', escape='"').csv(p)


def _mentions(s, d):
    p = _path(s, "mentions")
    src = mentions(s, d).withColumn("pmid", F.col("pmid").cast("string"))
    write_mentions(src.where("embed IS NOT NULL"), p)
    return s.read.parquet(p).groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("embed")).alias("cells"))


def _merged(s, d):
    p = _path(s, "grid")
    last = keep_last(grid(s, d), PK, [F.desc("ingested_at"), F.desc_nulls_last("icm")]).drop("ingested_at")
    merge_into(p, last.where("sample_idx < 2"), PK)
    merge_into(p, last.where("sample_idx >= 1").withColumn("n_clusters", F.col("n_clusters") + 1000), PK)
    return s.read.parquet(p).groupBy("sample_idx").agg(F.count(F.lit(1)).alias("n"), F.sum("n_clusters").alias("clusters")).select(F.col("sample_idx").cast("long").alias("sample_idx"), "n", "clusters")


def _streamed(s, d):
    schema = table(s, d, "mention_frame").schema
    stream = ingest.read_stream(s, f"{d}/mention_frame.parque[t]", schema)
    return ingest.run_totals(stream, f"totals_{uuid.uuid4().hex}", _path(s, "stream"))


def _linker(s, d, encoder=None):
    """A linker over the recorded vectors, or over the encoder's vectors of the mentions' lemmas."""
    kb = table(s, d, "kb").select("entity_id", entity_key("entity_id").alias("entity"))
    rows = usable_mentions(s, d)
    if encoder:
        rows = rows.withColumn("embed", encoder.column(lemma_key(tokens("mention"))))
    return pl.Linker.fit(rows, kb, pl.LinkerConfig(threshold=0.6))


def _selected(s, d):
    u = usable_mentions(s, d).where("entity IS NOT NULL")
    frames = {("recorded", "1"): u, ("unit", "1"): u.withColumn("embed", l2_normalise("embed"))}
    return pl.select_model(frames, pl.LinkerConfig(), 2)


QUERIES = {
    "r6_table_round_trip": _csv,
    "k1_mentions_round_trip": _mentions,
    "k2_merge_table": _merged,
    "k7_json_records": lambda s, d: json_rows(quality(s, d).select("row_id", *METRICS)).select(F.get_json_object("json", "$.row_id").cast("long").alias("row_id"), F.get_json_object("json", f"$.{METRICS[0]}").cast("double").alias("value")),
    "q22_flattened_summary": lambda s, d: aggregate_grid(keep_last(grid(s, d), PK, [F.desc("ingested_at"), F.desc_nulls_last("icm")]), ["model"]).select("model", F.struct("min_cluster_size", "n_clusters_mean").alias("s")).select("model", F.col("s.min_cluster_size").cast("long").alias("min_cluster_size"), F.round(F.col("s.n_clusters_mean") + 3e-11, 6).alias("n_clusters_mean")),
    "r32_origin": lambda s, d: with_origin(quality(s, d).withColumn("is_kb_match", F.col("oov_label") == 0), ["is_kb_match"]).groupBy("origin").agg(F.count(F.lit(1)).alias("n")),
    "q18_vocabulary_info": lambda s, d: table(s, d, "kb").agg(F.count(F.lit(1)).alias("vocabulary"), F.count_distinct("label").alias("n_labels")),
    "st_entity_totals": _streamed,
    "q10_fit_and_predict": lambda s, d: _linker(s, d).predict(usable_mentions(s, d)).select("row_id", "itext", "mention", "entity_id", F.round("score", 6).alias("score")),
    "q16_link_texts": lambda s, d: pl.link_texts(_linker(s, d, HashingEncoder()), table(s, d, "link").where("text IS NOT NULL").select(F.col("link_id").alias("itext"), "text"), HashingEncoder()),
    "q6_model_selection": _selected,
}
_LASTG = "g AS (SELECT * FROM grid_export QUALIFY row_number() OVER (PARTITION BY model, layer, sample_idx, min_cluster_size ORDER BY ingested_at DESC, icm DESC NULLS LAST) = 1)"
_EKEY = "nullif(lower(regexp_replace(entity, '[^\\p{L}\\p{N}]+', '', 'g')), '')"
SQL = {
    "r6_table_round_trip": "SELECT entity_id, label, description, example FROM kb",
    "k1_mentions_round_trip": f"SELECT {_EKEY} AS entity, count(*) AS n, sum(len(embed))::BIGINT AS cells FROM mention_frame WHERE embed IS NOT NULL GROUP BY 1",
    "k2_merge_table": f"WITH {_LASTG} SELECT sample_idx::BIGINT AS sample_idx, count(*) AS n, sum(n_clusters + CASE WHEN sample_idx >= 1 THEN 1000 ELSE 0 END)::BIGINT AS clusters FROM g GROUP BY 1",
    "k7_json_records": f"WITH {Q} SELECT row_id, {METRICS[0]} AS value FROM q",
    "q22_flattened_summary": f"WITH {_LASTG} SELECT model, min_cluster_size::BIGINT AS min_cluster_size, round(avg(n_clusters) + 3e-11, 6) AS n_clusters_mean FROM g GROUP BY ALL",
    "r32_origin": "SELECT CASE WHEN coalesce(oov_label = 0, false) THEN 'kb_match' ELSE 'oov' END AS origin, count(*) AS n FROM mention_quality_frame GROUP BY 1",
    "q18_vocabulary_info": "SELECT count(*) AS vocabulary, count(DISTINCT label) AS n_labels FROM kb",
    "st_entity_totals": f"SELECT {_EKEY} AS entity, count(*) AS n FROM mention_frame GROUP BY 1",
}
