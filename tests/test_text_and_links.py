"""Tokens, windows, chunks, phrases, matches and overlaps."""

import re

import pytest
from pyspark.sql import functions as F

from glossweave.functions import text as tx
from glossweave.operators import linking as lk


def one(spark, text, col):
    return spark.createDataFrame([(text,)], "t string").select(col.alias("x")).first()["x"]


def test_tokens_keep_offsets(spark):
    text = "Été: «naïve» tests\n\nof 3 proteins, bound."
    toks = one(spark, text, tx.tokens("t"))
    assert [text[t["ix"] : t["ix_end"]] for t in toks] == [t["text"] for t in toks] == re.findall(r"\w+|[^\w\s]", text)
    assert {t["text"]: t["lemma"] for t in toks}["proteins"] == "protein"
    assert [t["text"] for t in toks if t["is_stop"]] == ["of"]
    assert one(spark, None, tx.tokens("t")) is None and one(spark, "", tx.tokens("t")) == [] and one(spark, " \n", tx.tokens("t")) == []


def test_keep_rule(spark):
    for text, keep in (("the", False), ("of the", False), ("type of", True), ("x ,", False), ("", False)):
        assert one(spark, text, tx.keeps(tx.tokens("t"))) is keep


def test_windows(spark):
    df = spark.createDataFrame([("a b c",), ("a",), ("",)], "t string").withColumn("k", tx.tokens("t"))
    assert [r[0] for r in df.select(F.size(tx.windows(F.col("k"), 2))).collect()] == [2, 0, 0]


def test_boundaries(spark):
    w = one(spark, "be center aligned", tx.word_boundaries("t"))
    assert w[0]["s"] == "be" and w[-1]["s"] == "aligned" and w[-1]["b"] == 17
    assert one(spark, "", tx.word_boundaries("t")) == []


def test_chunks_match_the_rule(spark):
    text = "lorem ipsum dolor sit amet " * 20
    got = one(spark, text, tx.chunks("t", 100))
    assert "".join(got) == text and max(map(len, got)) <= 100
    assert got == ["".join(m) for m in re.findall(r"(.{1,99})(\s|$)|(.{1,100})", text)]


def test_phrases(spark):
    assert one(spark, "it depending well on x; depends on y; depends rather strongly on z", F.transform(tx.phrase_matches("t", "depends on"), lambda m: m["s"])) == ["depending well on", "depends on"]
    assert len(one(spark, "regulates the binding", tx.phrase_matches("t", "regulate binding"))) == 1


def test_context(spark):
    text = "one two three four five six seven"
    assert one(spark, text, tx.contexts("t", F.array(F.struct(F.lit(14).alias("a"), F.lit(18).alias("b"))), 2, 1)) == ["two three «four» five"]
    assert one(spark, None, tx.contexts("t", F.array(F.struct(F.lit(1).alias("a"), F.lit(2).alias("b"))))) == [""]


def test_scalars(spark):
    assert tx.layer_indices("3,1 2") == [-3, -2, -1]
    with pytest.raises(ValueError):
        tx.layer_indices("x")
    key = one(spark, "", tx.combination_key(F.array(F.lit("b/2"), F.lit("a/1"))))
    assert key == "2:a/1+b/2" and one(spark, key, tx.combination_members(F.col("t"))) == ["a/1", "b/2"]
    assert [one(spark, t, tx.word_grouping("t")) for t in ("a", " a  b ", "a b c d e", "", None)] == [1, 2, None, None, None]
    freq = F.create_map(F.lit("cell"), F.lit(0.5))
    assert one(spark, "of the", tx.simplicity(F.col("t"), freq)) == 1e-8
    assert one(spark, "cell", tx.simplicity(F.col("t"), freq)) == 0.5
    assert one(spark, "", tx.simplicity(F.col("t"), freq)) == 0.0


def test_matches_and_negatives(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, None), (3, "")], "doc long, text string")
    kb = spark.createDataFrame([("e1", "alphas"), ("e2", "beta"), ("e3", "a b c d")], "entity_id string, label string")
    rows = lk.corpus_mentions(docs, "doc", "text", kb, "neg").collect()
    assert {r["mention"] for r in rows if r["entity"] != "neg"} == {"alpha", "beta"}
    neg = [r for r in rows if r["entity"] == "neg"]
    assert len(neg) == 2 and not {r["mention"] for r in neg} & {"alpha", "beta"}


def test_islands(spark):
    def best(rows):
        df = spark.createDataFrame([(i, 1, m, a, b, None, None, s) for i, (m, a, b, s) in enumerate(rows)], "row_id long, itext long, mention string, a long, b long, a_abs long, b_abs long, score double")
        return {r["mention"] for r in lk.overlap_islands(df, "itext", "score", "row_id").collect()}

    assert best([("x", 0, 4, 0.5), ("y", 10, 15, 0.5)]) == {"x", "y"}
    assert best([("long", 0, 20, 0.5), ("short", 6, 14, 0.5)]) == {"short"}
    assert best([("long", 0, 20, 0.9), ("short", 6, 14, 0.5)]) == {"long"}
    assert best([("p", 0, 5, 0.5), ("q", 4, 9, 0.4), ("r", 8, 12, 0.3), ("s", 12, 13, 0.1)]) == {"p", "s"}
    assert best([("none", None, None, 0.1), ("p", 0, 5, 0.5)]) == {"none", "p"}


def test_gate_and_view(spark):
    preds = spark.createDataFrame([(1, 0, 0.9), (2, -1, 0.9), (3, 0, None), (4, 5, 0.9)], "row_id long, cluster int, score double")
    assign = spark.createDataFrame([("b", "B", 0), ("a", "A", 0)], "ord string, entity_id string, cluster int")
    assert {(r["row_id"], r["entity_id"]) for r in lk.gate(preds, assign, 0.5, F.lit(None).cast("boolean")).collect()} == {(1, "A")}
    over = lk.override_labels(preds.select("row_id", "cluster"), spark.createDataFrame([(2, 7)], "row_id long, cluster int"), "row_id")
    assert {tuple(r) for r in over.collect()} == {(1, 0), (2, 7), (3, 0), (4, 5)}


def test_links_are_the_best_windows_and_texts_are_passed_once(spark):
    import numpy as np

    from glossweave.operators.learning import LinearScreener
    from glossweave.operators.vectors import HashingEncoder
    from glossweave.plans import pipeline as pl

    enc = HashingEncoder()
    heads = [(c, (sum(map(enc.word, w.split())) / len(w.split())).tolist()) for c, w in enumerate(("cell growth", "binding protein", "kinase"))]
    linker = pl.Linker(
        pl.LinkerConfig(threshold=0.6), None, LinearScreener(np.zeros(64), 0.0, "lda"),
        spark.createDataFrame([(0, 1, "CG"), (1, 2, "BP")], "cluster int, ord int, entity_id string"), spark.createDataFrame(heads, "cluster int, embed array<double>"), 2,
    )
    texts = ["cell growth cell growth needs binding proteins, cells", "the kinase of cell growth. growth, cell", "growth growth growth growth", ""]
    docs = spark.createDataFrame([(7, texts[0]), (7, texts[1]), (8, texts[2]), (9, texts[3]), (None, texts[0]), (8, "x " + texts[1])], "itext long, text string")
    # brute force: all windows of all texts, gated, then resolved as one frame
    win = lk.mention_windows(docs, "itext", "text").withColumn("embed", enc.column("lemma"))
    seen = pl.to_heads(linker.screener.score(win, "embed", "p"), linker.heads.withColumnRenamed("cluster", "id"), 64)
    gated = lk.gate(seen, linker.assignments, 0.0, F.col("p") > 0)
    rows = gated.select(F.xxhash64("doc", "wg", "a", "b").alias("row_id"), F.col("doc").alias("itext"), "mention", *[F.col(x).cast("long").alias(c) for c, x in (("a", "a"), ("b", "b"), ("a_abs", "a"), ("b_abs", "b"))], "entity_id", "score")
    want = lk.public_view(lk.overlap_islands(rows, "itext", "score", "row_id").where("score >= 0.6"))
    got = pl.link_texts(linker, docs, enc)
    key = lambda df: sorted(((r["itext"] is None, r["itext"] or 0, r["mention"], r["a"], r["b"], r["entity_id"], round(r["score"], 9)) for r in df.collect()))
    assert key(got) == key(want) and len(key(want)) > 6
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and plan.count("MapInArrow") == 2


def test_mentions_are_found_in_place_without_a_shuffle_of_windows(spark, tmp_path):
    from glossweave.plans import assembly_queries as aq

    texts = ["type of \U0001f9ec cells, na\u00efve cells", "cells cells", ""]
    rows = [(1, texts[0], "x"), (None, texts[1], "x"), (3, texts[2], "x"), (4, None, "x")]
    spark.createDataFrame(rows, "doc_id long, text string, pmid string").write.parquet(str(tmp_path / "documents.parquet"))
    out = aq.QUERIES["s10_mention_substrings"](spark, str(tmp_path))
    # a text without an id has windows as well
    n = lk.mention_windows(spark.read.parquet(str(tmp_path / "documents.parquet")).where("text IS NOT NULL"), "doc_id", "text").count()
    assert [tuple(r) for r in out.collect()] == [(True, n)] and n > 8
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    wrong = spark.createDataFrame([(0, 4, "cell", "cell cell"), (1, 5, "cell", "cell cell"), (0, 5, "cell", "cell cell"), (5, 9, "cell", "cell cell")], "a int, b int, mention string, text string")
    assert {r["same"]: r["n"] for r in lk.mentions_in_place(wrong).collect()} == {True: 2, False: 2}
