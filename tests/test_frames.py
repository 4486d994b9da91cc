"""Mention-frame algebra on literal cases."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossweave.operators import frames as op
from glossweave.schema import conform, nan_to_null, require


def mentions(spark, rows, cols="row_id long, pmid string, entity string, mention string, embed array<double>"):
    return spark.createDataFrame(rows, cols)


def vec(df, key="entity"):
    return {r[key]: [round(float(x), 6) for x in r["embed"]] for r in df.collect()}


def test_mean_and_provenance(spark):
    df = mentions(spark, [(1, "1", "a", "x", [1.0, 0.0], None, 12), (2, "1", "a", "x", [0.0, 3.0], 10, 22), (3, None, "a", "x", [9.0, 9.0], 1, 1)], "row_id long, pmid string, entity string, mention string, embed array<double>, a_abs long, b_abs long")
    rows = op.mean_by_keys(df).collect()
    assert len(rows) == 1 and list(rows[0]["embed"]) == [0.5, 1.5] and (rows[0]["a_abs"], rows[0]["b_abs"]) == (10, 12)


def test_fusion(spark):
    a = mentions(spark, [(1, "1", "a", "x", [0.0, 2.0]), (2, "1", "a", "x", [2.0, 0.0]), (3, "1", "b", "y", [0.0, 1.0])])
    b = mentions(spark, [(1, "1", "a", "x", [1.0, 1.0]), (2, "1", "b", "z", [3.0, 3.0])])
    assert vec(op.fuse([a, b])) == {"a": [1.0, 1.0, 1.0, 1.0]}
    assert set(vec(op.fuse([a]))) == {"a", "b"}
    assert vec(op.fuse_entities([a, b])) == {"a": [1.0, 1.0, 1.0, 1.0], "b": [0.0, 1.0, 3.0, 3.0]}
    with pytest.raises(ValueError):
        op.fuse([])


def test_caps_and_rarity(spark):
    rows = [(i, "1", "kb_a" if i < 30 else "kb_b" if i < 35 else "negative", "m", [1.0]) for i in range(85)] + [(90, "1", None, "m", [1.0])]
    df = mentions(spark, rows)
    count = lambda d: {r["entity"]: r["count"] for r in d.groupBy("entity").count().collect()}
    assert count(op.cap_per_entity(df, 10, "negative")) == {"kb_a": 10, "kb_b": 5, "negative": 50, None: 1}
    assert count(op.cap_per_entity(df, 10, "negative", 8))["negative"] == 8
    assert count(op.drop_rare(df, 6, "negative")) == {"kb_a": 30, "negative": 50, None: 1}
    assert count(op.drop_rare(df, 99, "negative")) == {"negative": 50, None: 1}
    with pytest.raises(ValueError):
        op.cap_per_entity(df, 0, "negative")


def test_stratified_counts():
    assert op.stratified_counts(100, 200, 500) == (29, 71)
    assert op.stratified_counts(1, 5, 5) == (1, 1)
    assert op.stratified_counts(4, 0, 9) == (0, 4)
    assert op.stratified_counts(4, 0, 0) == (0, 0)
    assert sum(op.stratified_counts(9, 1, 9)) == 9


def test_samples_are_seeded(spark):
    df = mentions(spark, [(i, "1", "negative" if i % 4 == 0 else "kb", "m", [1.0]) for i in range(700)])
    ids = lambda d: {r["row_id"] for r in d.collect()}
    a, b, c = (ids(op.stratified_sample(df, 100, "negative", s)) for s in (1, 1, 2))
    assert a == b != c and len(a) == len(c) == 100
    assert {i % 4 == 0 for i in a} == {True, False}
    assert len(ids(op.stratified_sample(df, 9999, "negative"))) == 700
    f = op.folds(df, "entity", 5)
    sizes = {(r["entity"], r["fold"]): r["count"] for r in f.groupBy("entity", "fold").count().collect()}
    assert sorted(v for (e, _), v in sizes.items() if e == "kb") == [105] * 5


def test_large_samples_and_ranks_match_a_plain_order(spark):
    df = spark.range(30_000).select(F.col("id").alias("row_id"), F.when(F.col("id") % 9 == 0, None).otherwise(F.col("id") % 2).alias("y"))
    plain = df.orderBy(op.draw("row_id", 4), "row_id").limit(12_345)
    got = op.top_by_draw(df, 12_345, 4)
    assert got.count() == 12_345 and got.exceptAll(plain).count() == 0
    assert op.top_by_draw(df, 99_999, 4).count() == 30_000
    w = Window.partitionBy("y").orderBy(op.draw("row_id", 4), "row_id")
    want = df.select("row_id", (F.row_number().over(w) - 1).cast("long").alias("r"))
    ranked = op.rank_by_draw(df, "y", 4).select("row_id", F.col("__rank").cast("long").alias("r"))
    assert ranked.count() == 30_000 and ranked.exceptAll(want).count() == 0


def test_upsert_keeps_the_newest(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert {tuple(r) for r in op.upsert(old, new, ["k"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert op.upsert(old.limit(0), new.limit(0), ["k"]).count() == 0


def test_knowledge_base_helpers(spark):
    kb = spark.createDataFrame([("a", "A", None, "1"), ("a", "B", "d", "2"), ("c", "obsolete x", "d", "3"), ("d", None, "d", "4"), ("e", "B", "z", "5")], "entity_id string, label string, description string, ord string")
    assert {tuple(r) for r in op.labels_map(kb).collect()} == {("a", "B"), ("c", "obsolete x"), ("e", "B")}
    assert {(r["label"], r["entity_id"]) for r in op.first_id_by_label(kb).collect()} == {("A", "a"), ("B", "a"), ("obsolete x", "c")}
    merged = op.merge_knowledge_bases(kb.withColumn("example", F.lit(None).cast("string")))
    assert {(r["entity_id"], r["label"]) for r in merged.collect()} == {("a", "B")}
    todo = spark.createDataFrame([(None, "z"), (None, "y"), ("k", "x")], "entity_id string, label string")
    assert {tuple(r) for r in op.number_entities(todo, 7).collect()} == {("y", "KB.000007"), ("z", "KB.000008")}


def test_schema_helpers(spark):
    df = spark.createDataFrame([(1, "a", "m", [1.0, 2.0, 3.0]), (2, "a", "m", [1.0])], "pmid int, entity string, mention string, embed array<double>")
    out = conform(df)
    assert out.columns[:3] == ["pmid", "entity", "mention"] and out.count() == 2 and out.schema["a_abs"].dataType.simpleString() == "bigint"
    with pytest.raises(ValueError):
        require(df, ["nope"])
    assert nan_to_null(spark.createDataFrame([(float("nan"), 1)], "x double, y int")).first()["x"] is None
