"""Text operators over documents and links, and the link path over the mention frame."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossweave.functions import text as tx
from glossweave.functions.keys import entity_key
from glossweave.operators import composition as comp
from glossweave.operators import linking as lk
from glossweave.plans.frames_sql import KB, NEG, M, Q, mentions, quality
from glossweave.tables import numbered_rows, table

_PHRASE = "depends on"


def _docs(s, d):
    """Documents by their whole texts."""
    return table(s, d, "documents").select(F.col("doc_id").alias("doc"), "text", "pmid").where("text IS NOT NULL")


def _links(s, d):
    return table(s, d, "link").select(F.col("link_id").alias("doc"), "text").where("text IS NOT NULL")


def _kb(s, d):
    return table(s, d, "kb")


def _pred(s, d):
    """Mentions with the cluster and score that the quality frame gives them first."""
    q = quality(s, d).where("cluster IS NOT NULL").groupBy("mention_id").agg(F.min(F.struct("row_id", "cluster", "pca_residual")).alias("q"))
    m = mentions(s, d).select("row_id", "mention", "a", "b", "a_abs", "b_abs", "itext")
    return m.join(q.select(F.col("mention_id").alias("row_id"), "q.cluster", F.coalesce(F.round(1 - F.col("q.pca_residual"), 4), F.lit(0.0)).alias("score")), "row_id")


def _assign(s, d):
    """Each identifier's most frequent recorded cluster."""
    labels = _kb(s, d).select("entity_id", entity_key("entity_id").alias("entity"))
    return comp.provisional_assignments(labels, quality(s, d).where("entity IS NOT NULL AND cluster IS NOT NULL")).withColumn("ord", F.col("entity_id"))


_n = lambda c: F.count(F.lit(1)).alias(c)
QUERIES = {
    "s6_tokens": lambda s, d: _docs(s, d).select("doc", F.inline(tx.tokens("text"))).select("doc", F.col("ix").cast("long").alias("ix"), F.col("ix_end").cast("long").alias("ix_end"), "text", "lemma", "is_stop"),
    "s7_word_groupings": lambda s, d: _kb(s, d).select("entity_id", tx.word_grouping("label").cast("long").alias("wg")),
    "s2_sentences": lambda s, d: _docs(s, d).select("doc", F.posexplode(tx.sentences("text")).alias("n", "sentence")),
    "s3_chunks": lambda s, d: lk.text_chunks(_links(s, d), "doc", "text", 200),
    "s5_word_boundaries": lambda s, d: _docs(s, d).select("doc", F.inline(tx.word_boundaries("text"))).groupBy("doc").agg(_n("n"), F.sum(F.col("b") - F.col("a")).alias("chars")),
    "s1_phrase_matches": lambda s, d: _docs(s, d).select("doc", F.inline(tx.phrase_matches("text", _PHRASE)).alias("found", "a", "b")).groupBy("doc", "found").agg(_n("n")),
    "s12_combination_keys": lambda s, d: table(s, d, "grid_export").groupBy("model").agg(F.collect_set(F.concat_ws("/", "model", "layer")).alias("m")).select("model", tx.combination_key(F.col("m")).alias("key")),
    "s14_word_spans": lambda s, d: _docs(s, d).select("doc", F.inline(tx.word_spans("text"))).groupBy("doc").agg(_n("n"), F.max("b").cast("long").alias("last"), F.sum(F.col("b") - F.col("a")).alias("chars")),
    "s15_clean_phrases": lambda s, d: table(s, d, "kb_extension").select(F.trim("label").alias("phrase")).where("phrase <> ''").distinct(),
    "s18_simplicity": lambda s, d: _simplicity(s, d),
    "s19_word_frequencies": lambda s, d: _frequencies(s, d),
    "w12_windows": lambda s, d: lk.mention_windows(_docs(s, d), "doc", "text").groupBy("doc", "wg").agg(_n("n")).select("doc", F.col("wg").cast("long").alias("wg"), "n"),
    "proj14_groupings": lambda s, d: lk.mention_windows(_links(s, d), "doc", "text").select(F.col("wg").cast("long").alias("wg")).distinct(),
    "j9_lemma_matches": lambda s, d: lk.lemma_matches(lk.mention_windows(_docs(s, d), "doc", "text"), lk.lemma_index(_kb(s, d))).select("doc", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "mention", "label"),
    "j10_lemma_index": lambda s, d: lk.lemma_index(_kb(s, d)).select(F.col("wg").cast("long").alias("wg"), "lemma", "label"),
    "s21_corpus_mentions": lambda s, d: lk.corpus_mentions(_docs(s, d), "doc", "text", _kb(s, d), NEG).select("doc", "entity", "mention", "a", "b", "wg"),
    "w13_chunk_offsets": lambda s, d: lk.text_chunks(_links(s, d), "doc", "text", 500).groupBy("doc").agg(_n("n"), F.max(F.col("start") + F.length("chunk")).alias("end")),
    "j16_span_join": lambda s, d: mentions(s, d).where("itext IS NOT NULL AND a_abs IS NOT NULL").select("itext", "row_id", "a_abs", "b_abs").alias("x")
    .join(mentions(s, d).where("itext IS NOT NULL AND a_abs IS NOT NULL").select("itext", F.col("row_id").alias("other"), F.col("a_abs").alias("c"), F.col("b_abs").alias("e")).alias("y"), "itext")
    .where("row_id < other AND a_abs < e AND b_abs > c AND e > c AND b_abs > a_abs").select("itext", "row_id", "other"),
    "w10_overlap_islands": lambda s, d: lk.overlap_islands(_pred(s, d), "itext", "score", "row_id").select("row_id", "itext", "mention"),
    "w20_context_windows": lambda s, d: lk.with_context(lk.lemma_matches(lk.mention_windows(_docs(s, d), "doc", "text"), lk.lemma_index(_kb(s, d))), _docs(s, d)).select("doc", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "context"),
    "j12_cluster_entities": lambda s, d: lk.cluster_entities(_assign(s, d)).select(F.col("cluster").cast("long").alias("cluster"), "entity_id"),
    "proj13_prediction_gate": lambda s, d: lk.gate(_pred(s, d), _assign(s, d), 0.3, F.col("score") < 0.1).select("row_id", "entity_id", "score"),
    "proj9_score_filter": lambda s, d: _pred(s, d).where(F.coalesce("score", F.lit(0.0)) >= 0.5).select("row_id", "score"),
    "j13_override_labels": lambda s, d: lk.override_labels(_pred(s, d).select("row_id", "cluster"), _fitted(s, d), "row_id").select("row_id", F.col("cluster").cast("long").alias("cluster")),
    "j11_kb_validation": lambda s, d: lk.validate(
        _recorded(s, d),
        lk.lemma_index(_kb(s, d)), _kb(s, d)).groupBy("is_kb_match").agg(_n("n")),
    "proj15_public_view": lambda s, d: lk.public_view(lk.gate(_pred(s, d), _assign(s, d), 0.3, F.lit(False))),
    "r29_document_index": lambda s, d: numbered_rows(table(s, d, "link").select("link_id"), ["link_id"], "itext"),
    "r14_model_filenames": lambda s, d: table(s, d, "grid_export").select(F.concat(F.lit("res_"), "model", F.lit("_"), F.regexp_replace("layer", ",", ""), F.lit(".parquet")).alias("name")).distinct()
    .select("name", F.regexp_extract("name", r"^res_([^_]+)_(\d+)\.parquet", 1).alias("model"), F.regexp_extract("name", r"^res_([^_]+)_(\d+)\.parquet", 2).alias("layer")),
    "proj12_clean_kb": lambda s, d: table(s, d, "kb_extension").where(F.col("label").isNotNull() & ~F.col("label").contains(" low ") & ~F.coalesce(F.col("description"), F.lit("")).contains("inverse")).select("entity_id", "label"),
    "t9_natural_order": lambda s, d: quality(s, d).select(F.coalesce(F.col("layer"), F.lit("")).alias("label")).distinct().select("label", F.try_to_number("label", F.lit("999")).isNull().alias("is_text")),
    "r33_triples_join": lambda s, d: _triples(s, d),
}


def _fitted(s, d):
    """The cluster that the last known row of each mention says, as the labels of a fit."""
    q = quality(s, d).where("cluster >= 0 AND oov_label = 0").groupBy("mention_id").agg(F.max(F.struct("row_id", "cluster")).alias("q"))
    return q.select(F.col("mention_id").alias("row_id"), "q.cluster")


def _recorded(s, d):
    """Recorded mentions with their lemma and the entity of their cluster."""
    lemma = tx.lemma_key(tx.tokens("mention"))
    m = _pred(s, d).select("row_id", "mention", "cluster", lemma.alias("lemma"), tx.word_grouping("mention").alias("wg"))
    return m.join(F.broadcast(lk.cluster_entities(_assign(s, d))), "cluster")  # as many rows as clusters


def _triples(s, d):
    """Properties with their labels and definitions from (subject, predicate, object) rows."""
    kb = table(s, d, "kb")
    t = kb.select("entity_id", F.lit("type").alias("p"), F.lit("property").alias("o")).unionByName(kb.where("label IS NOT NULL").select("entity_id", F.lit("label").alias("p"), F.col("label").alias("o"))).unionByName(kb.where("description IS NOT NULL").select("entity_id", F.lit("definition").alias("p"), F.col("description").alias("o")))
    of = lambda p, n: t.where(F.col("p") == p).select("entity_id", F.col("o").alias(n))
    return of("type", "kind").join(of("label", "label"), "entity_id", "left").join(of("definition", "definition"), "entity_id", "left").drop("kind")


def _frequencies(s, d):
    words = _docs(s, d).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))).alias("word"))
    n = words.groupBy("word").agg(_n("n"))
    return n


def _simplicity(s, d):
    """Simplicity of every label, each word's frequency taken from all documents by a join (no map of the vocabulary)."""
    labels = _kb(s, d).where("label IS NOT NULL").select("entity_id", "label")
    words = labels.select("entity_id", F.explode(F.split(F.lower(F.trim("label")), r"\s+")).alias("word")).distinct()
    n = _frequencies(s, d)
    total = n.agg(F.sum("n").alias("t")).first()["t"] or 1
    freq = words.join(n, "word").groupBy("entity_id").agg(F.map_from_entries(F.collect_list(F.struct("word", (F.col("n") / F.lit(total)).alias("f")))).alias("f"))
    return labels.join(freq, "entity_id", "left").select("entity_id", F.round(tx.simplicity(F.col("label"), F.coalesce("f", F.create_map().cast("map<string,double>"))) + 3e-14, 12).alias("simplicity"))


_DOCS = "docs AS (SELECT doc_id AS doc, text FROM documents WHERE text IS NOT NULL)"
_STOPS = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)
_TOK = r"""p AS (SELECT doc, unnest(regexp_extract_all(text, '[\s\p{Z}\x{85}\x{1c}-\x{1f}]+|[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}\x{85}\x{1c}-\x{1f}]')) AS s, unnest(range(len(regexp_extract_all(text, '[\s\p{Z}\x{85}\x{1c}-\x{1f}]+|[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}\x{85}\x{1c}-\x{1f}]')))) AS i FROM docs),
 o AS (SELECT doc, s, i, sum(length(s)) OVER (PARTITION BY doc ORDER BY i) - length(s) AS ix FROM p),
 tk AS (SELECT doc, ix::BIGINT AS ix, (ix + length(s))::BIGINT AS ix_end, s AS text, CASE WHEN length(s) > 4 THEN regexp_replace(lower(s), '(ing|ed|es|s)$', '') ELSE lower(s) END AS lemma, lower(s) IN (""" + _STOPS + r""") AS is_stop,
   regexp_matches(s, '^[\p{L}\p{N}_]') AS is_word, row_number() OVER (PARTITION BY doc ORDER BY i) AS n FROM o WHERE NOT regexp_matches(s, '^[\s\p{Z}\x{85}\x{1c}-\x{1f}]'))"""
_WIN = """w1 AS (SELECT doc, 1 AS wg, ix AS a, ix_end AS b, lemma FROM tk WHERE is_word AND NOT is_stop),
 l AS (SELECT *, lead(ix_end) OVER w AS e2, lead(lemma) OVER w AS l2, lead(is_stop) OVER w AS s2, lead(is_word) OVER w AS d2, lead(ix_end, 2) OVER w AS e3, lead(lemma, 2) OVER w AS l3, lead(is_stop, 2) OVER w AS s3, lead(is_word, 2) OVER w AS d3 FROM tk WINDOW w AS (PARTITION BY doc ORDER BY n)),
 win AS (FROM w1 UNION ALL SELECT doc, 2, ix, e2, lemma || ' ' || l2 FROM l WHERE is_word AND d2 AND NOT (is_stop AND s2) UNION ALL SELECT doc, 3, ix, e3, lemma || ' ' || l2 || ' ' || l3 FROM l WHERE is_word AND d2 AND d3 AND NOT (is_stop AND s2 AND s3))"""
_LEM = r"CASE WHEN length(w) > 4 THEN regexp_replace(lower(w), '(ing|ed|es|s)$', '') ELSE lower(w) END"
_INDEX = r"""kt AS (SELECT label, len(regexp_split_to_array(trim(label), '\s+')) AS wg, array_to_string([""" + _LEM + r""" for w in regexp_extract_all(label, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')], ' ') AS lemma FROM kb WHERE label IS NOT NULL),
 ki AS (SELECT wg, lemma, min(label) AS label FROM kt WHERE wg <= 3 AND lemma <> '' GROUP BY ALL)"""
_PRED = Q + ", " + M + """, f AS (SELECT mention_id AS row_id, arg_min(cluster, row_id) AS cluster, arg_min(coalesce(pca_residual, 'nan'::DOUBLE), row_id) AS res FROM q WHERE cluster IS NOT NULL GROUP BY ALL),
 pr AS (SELECT m.* EXCLUDE (embed), cluster, CASE WHEN isnan(res) THEN 0.0::DOUBLE ELSE round(1 - res, 4) END AS score FROM m JOIN f USING (row_id))"""
_AS = r"""vt AS (SELECT lower(regexp_replace(entity, '[^\p{L}\p{N}]+', '', 'g')) AS entity, cluster, count(*) AS n FROM mention_quality_frame WHERE cluster >= 0 AND entity IS NOT NULL GROUP BY ALL),
 md AS (SELECT entity, cluster FROM vt QUALIFY row_number() OVER (PARTITION BY entity ORDER BY n DESC, cluster) = 1),
 asg AS (SELECT entity_id, cluster FROM kb JOIN md ON md.entity = lower(regexp_replace(entity_id, '[^\p{L}\p{N}]+', '', 'g'))), ce AS (SELECT cluster, min(entity_id) AS entity_id FROM asg GROUP BY 1)"""
_SP = r"[ \t\n\x{0b}\f\r]"
_DOT = r"[^\n\r\x{85}\x{2028}\x{2029}]"


def _chunk_sql(most: int) -> str:
    """``chunks`` of every link text with the characters before each."""
    found = rf"regexp_extract_all(text, '{_DOT}{{1,{most - 1}}}(?:{_SP}|\z)|{_DOT}{{1,{most}}}')"
    return f"""ck AS (SELECT link_id AS doc, unnest(range(len({found}))) AS ichunk, unnest({found}) AS chunk FROM link WHERE text IS NOT NULL),
      c AS (SELECT *, sum(length(chunk)) OVER (PARTITION BY doc ORDER BY ichunk) - length(chunk) AS start FROM ck)"""


_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(133) || chr(160) || chr(28) || chr(29) || chr(30) || chr(31)"
SQL = {
    "s7_word_groupings": r"SELECT entity_id, CASE WHEN trim(label) <> '' AND len(regexp_split_to_array(trim(label), '\s+')) BETWEEN 1 AND 4 THEN len(regexp_split_to_array(trim(label), '\s+')) END AS wg FROM kb",
    "s6_tokens": f"WITH {_DOCS}, {_TOK} SELECT doc, ix, ix_end, text, lemma, is_stop FROM tk",
    "s14_word_spans": rf"WITH {_DOCS} SELECT doc, len(r) AS n, length(rtrim(text, {_WS})) AS last, list_sum([length(x) for x in r])::BIGINT AS chars FROM (SELECT doc, text, regexp_extract_all(text, '[^\s\p{{Z}}\x{{85}}\x{{1c}}-\x{{1f}}]+') AS r FROM docs) WHERE len(r) > 0",
    "s5_word_boundaries": rf"WITH {_DOCS} SELECT doc, len(r) AS n, list_sum([length(x) for x in r])::BIGINT AS chars FROM (SELECT doc, regexp_extract_all(text, '[^\s\p{{Z}}\x{{85}}\x{{1c}}-\x{{1f}}!-/:-@\[-`{{-~]+') AS r FROM docs) WHERE len(r) > 0",
    "s21_corpus_mentions": f"""WITH {_DOCS}, {_TOK}, {_WIN}, {_INDEX}, ps AS (SELECT win.*, label FROM win JOIN ki USING (wg, lemma)), want AS (SELECT doc, round_even(1.0 * count(*), 0) AS k FROM ps GROUP BY 1),
       ng AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY (doc * 31 + a * 7919 + wg * 104729) % 10007, a, wg) AS r FROM win ANTI JOIN ps USING (doc, wg, a, b)), al AS (SELECT doc, label AS entity, a, b, wg FROM ps UNION ALL SELECT ng.doc, '{NEG}', a, b, wg FROM ng JOIN want USING (doc) WHERE r <= k)
       SELECT al.doc, entity, substring(text, (a + 1)::INT, (b - a)::INT) AS mention, a, b, wg FROM al JOIN docs USING (doc)""",
    "s1_phrase_matches": rf"WITH {_DOCS}, f AS (SELECT doc, text, unnest(regexp_extract_all(text, '\bdepend[\p{{L}}\p{{N}}_]*\s+[\p{{L}}\p{{N}}_\s-]{{0,9}}\bon[\p{{L}}\p{{N}}_]*')) AS found FROM docs) SELECT doc, found, count(*) AS n FROM f GROUP BY ALL",
    "s2_sentences": rf"""WITH {_DOCS}, f AS (SELECT doc, regexp_replace(text, '{_SP}+', ' ', 'g') AS t FROM docs),
       g AS (SELECT doc, [regexp_replace(regexp_replace(x, '^[ +]+', ''), '[ +]+$', '') for x in string_split(regexp_replace(t, '([^A-Z][.!?]) ?([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1))] AS x FROM f),
       h AS (SELECT doc, [y for y in x if y <> ''] AS x FROM g) SELECT doc, unnest(range(len(x))) AS n, unnest(x) AS sentence FROM h""",
    "s3_chunks": f"WITH {_chunk_sql(200)} SELECT doc, ichunk, chunk, start::BIGINT AS start FROM c",
    "w13_chunk_offsets": f"WITH {_chunk_sql(500)} SELECT doc, count(*) AS n, max(start + length(chunk))::BIGINT AS \"end\" FROM c GROUP BY doc",
    "w20_context_windows": rf"""WITH {_DOCS}, {_TOK}, {_WIN}, {_INDEX}, mt AS (SELECT win.doc, a, b FROM win JOIN ki USING (wg, lemma)),
       pc AS (SELECT doc, unnest(regexp_extract_all(text, '[\s\p{{Z}}\x{{85}}\x{{1c}}-\x{{1f}}]+|[^\s\p{{Z}}\x{{85}}\x{{1c}}-\x{{1f}}]+')) AS s, generate_subscripts(regexp_extract_all(text, '[\s\p{{Z}}\x{{85}}\x{{1c}}-\x{{1f}}]+|[^\s\p{{Z}}\x{{85}}\x{{1c}}-\x{{1f}}]+'), 1) AS i FROM docs),
       ws AS (SELECT doc, s, (sum(length(s)) OVER (PARTITION BY doc ORDER BY i) - length(s))::BIGINT AS x, (sum(length(s)) OVER (PARTITION BY doc ORDER BY i))::BIGINT AS y FROM pc),
       w AS (SELECT * FROM ws WHERE NOT regexp_matches(s, '^[\s\p{{Z}}\x{{85}}\x{{1c}}-\x{{1f}}]')),
       j AS (SELECT mt.doc, a, b, (list(s ORDER BY x) FILTER (y <= a))[-5:] AS l, list(s ORDER BY x) FILTER (x < b AND y > a) AS m, (list(s ORDER BY x) FILTER (x >= b))[:5] AS r
         FROM (SELECT *, row_number() OVER () AS k FROM mt) mt JOIN w USING (doc) GROUP BY mt.k, mt.doc, a, b)
       SELECT doc, a, b, array_to_string(list_concat(list_concat(coalesce(l, []), ['«' || array_to_string(m, ' ') || '»']), coalesce(r, [])), ' ') AS context FROM j""",
    "s12_combination_keys": "SELECT model, len(list(DISTINCT layer)) || ':' || array_to_string(list_sort(list(DISTINCT model || '/' || layer)), '+') AS key FROM grid_export GROUP BY model",
    "s15_clean_phrases": "SELECT DISTINCT trim(label) AS phrase FROM kb_extension WHERE trim(label) <> ''",
    "s18_simplicity": rf"""WITH {_DOCS}, n AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM docs) GROUP BY 1), f AS (SELECT word, n / (SELECT sum(n) FROM n) AS f FROM n),
       lb AS (SELECT entity_id, regexp_split_to_array(lower(trim(label)), '\s+') AS ws FROM kb WHERE label IS NOT NULL), x AS (SELECT entity_id, len(ws) AS nw, unnest(ws) AS word FROM lb),
       c AS (SELECT entity_id, any_value(nw) AS nw, count(*) FILTER (NOT st) AS k, sum(1 / greatest(coalesce(f, 1e-8), 1e-8)) FILTER (NOT st) AS inv FROM (SELECT x.*, f, word IN ('is','of','the','a','an','to','for','or','in','has') AS st FROM x LEFT JOIN f USING (word)) GROUP BY 1)
       SELECT entity_id, round(CASE WHEN k = 0 THEN 1e-8 ELSE k / inv * CASE WHEN nw > 1 THEN greatest(0, 1 - 0.2 * (nw - 1)) * CASE WHEN nw > k THEN greatest(0, 1 - 0.3 * (nw - k)) ELSE 1 END ELSE 1 END END + 3e-14, 12) AS simplicity FROM c""",
    "s19_word_frequencies": f"WITH {_DOCS} SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM docs) GROUP BY 1",
    "w12_windows": f"WITH {_DOCS}, {_TOK}, {_WIN} SELECT doc, wg::BIGINT AS wg, count(*) AS n FROM win GROUP BY ALL",
    "proj14_groupings": f"WITH docs AS (SELECT link_id AS doc, text FROM link WHERE text IS NOT NULL), {_TOK}, {_WIN} SELECT DISTINCT wg::BIGINT AS wg FROM win",
    "j9_lemma_matches": f"WITH {_DOCS}, {_TOK}, {_WIN}, {_INDEX} SELECT win.doc, a, b, substring(docs.text, (a + 1)::INT, (b - a)::INT) AS mention, label FROM win JOIN ki USING (wg, lemma) JOIN docs ON docs.doc = win.doc",
    "j10_lemma_index": f"WITH {_INDEX} SELECT wg::BIGINT AS wg, lemma, label FROM ki",
    "j16_span_join": f"WITH {M}, n AS (SELECT * FROM m WHERE itext IS NOT NULL AND a_abs IS NOT NULL) SELECT x.itext, x.row_id, y.row_id AS other FROM n x JOIN n y ON x.itext = y.itext AND x.row_id < y.row_id AND x.a_abs < y.b_abs AND x.b_abs > y.a_abs AND y.b_abs > y.a_abs AND x.b_abs > x.a_abs",
    "w10_overlap_islands": f"""WITH {_PRED}, iv AS (SELECT *, CASE WHEN coalesce(b_abs, b) IS NOT NULL THEN coalesce(a_abs, a) END AS x, CASE WHEN coalesce(a_abs, a) IS NOT NULL THEN coalesce(b_abs, b) END AS y FROM pr),
       mk AS (SELECT *, CASE WHEN max(y) OVER w IS NULL OR x >= max(y) OVER w THEN 1 ELSE 0 END AS nw FROM iv WHERE x IS NOT NULL AND itext IS NOT NULL WINDOW w AS (PARTITION BY itext ORDER BY x, y, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
       isl AS (SELECT *, sum(nw) OVER (PARTITION BY itext ORDER BY x, y, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM mk)
       SELECT row_id, itext, mention FROM isl QUALIFY row_number() OVER (PARTITION BY itext, island ORDER BY score DESC, greatest(y - x, 0), mention, row_id) = 1 UNION ALL SELECT row_id, itext, mention FROM iv WHERE x IS NULL OR itext IS NULL""",
    "j12_cluster_entities": f"WITH {_AS} SELECT cluster::BIGINT AS cluster, entity_id FROM ce",
    "proj13_prediction_gate": f"WITH {_PRED}, {_AS} SELECT row_id, entity_id, score FROM pr JOIN ce USING (cluster) WHERE NOT score < 0.1 AND cluster <> -1 AND score >= 0.3",
    "proj9_score_filter": f"WITH {_PRED} SELECT row_id, score FROM pr WHERE score >= 0.5",
    "j13_override_labels": f"WITH {_PRED}, ft AS (SELECT mention_id AS row_id, arg_max(cluster, row_id) AS fit FROM q WHERE cluster >= 0 AND oov_label = 0 GROUP BY 1) SELECT row_id, coalesce(fit, cluster)::BIGINT AS cluster FROM pr LEFT JOIN ft USING (row_id)",
    "j11_kb_validation": f"""WITH {_PRED}, {_INDEX}, {_AS}, ml AS (SELECT row_id, cluster, CASE WHEN trim(mention) <> '' AND len(regexp_split_to_array(trim(mention), '\\s+')) BETWEEN 1 AND 4 THEN len(regexp_split_to_array(trim(mention), '\\s+')) END AS wg,
       array_to_string([{_LEM} for w in regexp_extract_all(mention, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s]')], ' ') AS lemma FROM pr)
       SELECT coalesce(ki.label = kb.label, false) AS is_kb_match, count(*) AS n FROM ml JOIN ce USING (cluster) LEFT JOIN ki USING (wg, lemma) LEFT JOIN kb USING (entity_id) GROUP BY 1""",
    "proj15_public_view": f"WITH {_PRED}, {_AS} SELECT itext, mention, coalesce(a_abs, a) AS a, coalesce(b_abs, b) AS b, entity_id, score FROM pr JOIN ce USING (cluster) WHERE cluster <> -1 AND score >= 0.3",
    "r29_document_index": "SELECT link_id, row_number() OVER (ORDER BY link_id) - 1 AS itext FROM link",
    "r14_model_filenames": r"SELECT name, regexp_extract(name, '^res_([^_]+)_(\d+)\.parquet', 1) AS model, regexp_extract(name, '^res_([^_]+)_(\d+)\.parquet', 2) AS layer FROM (SELECT DISTINCT 'res_' || model || '_' || replace(layer, ',', '') || '.parquet' AS name FROM grid_export)",
    "proj12_clean_kb": "SELECT entity_id, label FROM kb_extension WHERE label IS NOT NULL AND NOT contains(label, ' low ') AND NOT contains(coalesce(description, ''), 'inverse')",
    "t9_natural_order": "SELECT DISTINCT coalesce(layer, '') AS label, TRY_CAST(layer AS BIGINT) IS NULL AS is_text FROM mention_quality_frame",
    "r33_triples_join": "SELECT entity_id, label, description AS definition FROM kb",
}
SQL = {k: v for k, v in SQL.items() if v}
