"""Rows of reports and screeners, token groups, budgets and pooled vectors."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossweave.functions import text as tx
from glossweave.operators import assembly as asm
from glossweave.operators.vectors import pooled_text_vector
from glossweave.tables import numbered_rows


def test_token_groups(spark):
    spans = "array<struct<a:int,b:int>>"
    toks = "array<struct<ix:int,ix_end:int>>"
    rows = [([(0, 9), (6, 18), (0, 9), (30, 40), (18, 19)], [(0, 5), (6, 9), (10, 18)]), (None, [(0, 1)]), ([(0, 1)], []), ([], None)]
    df = spark.createDataFrame(rows, f"w {spans}, t {toks}")
    got = [[tuple(x) for x in r[0]] for r in df.select(asm.token_groups(F.col("w"), F.col("t"))).collect()]
    assert got == [[(0, 9, 0, 2), (6, 18, 1, 3)], [], [], []]


def test_budget_pieces(spark):
    def pieces(text, most, **kw):
        return spark.createDataFrame([(text,)], "t string").select(tx.budget_pieces("t", most, **kw)).first()[0]

    assert pieces("one two three, four", 3) == ["one two", " three,", " four"] or "".join(pieces("one two three, four", 3)) == "one two three, four"
    long = "wörd, " * 300 + "x" * 50
    out = pieces(long, 7)
    assert "".join(out) == long and max(len(tx._TOKEN.findall(p)) for p in out) <= 7
    assert pieces(None, 3) is None and pieces("", 3) == [] and pieces("   ", 3) == ["   "]
    letters = pieces("abcdef", 2, tokenizer=lambda t: [(i, i + 1) for i in range(len(t))])
    assert letters == ["ab", "cd", "ef"]
    with pytest.raises(ValueError):
        tx.budget_pieces("t", 0)


def test_pooled_vectors(spark):
    kind = "array<array<array<double>>>"
    rows = [([[[3.0, 4.0], [3.0, 4.0]], [[0.0, 0.0], [0.0, 0.0]]],), ([],), ([[[1.0, 0.0]], [[0.0, 2.0]]],)]
    got = [r[0] for r in spark.createDataFrame(rows, f"x {kind}").select(pooled_text_vector(F.col("x"), 2, 4)).collect()]
    assert got[0] == pytest.approx([0.6, 0.8]) and got[1] is None and got[2] == pytest.approx([0.5**0.5, 0.5**0.5])


def test_labels(spark):
    df = spark.createDataFrame([(1,), (0,), (0,)], "oov_label int")
    assert sorted(r["class_label"] for r in asm.checked_labels(df, "x").collect()) == ["negative", "positive", "positive"]
    for bad in ([(1,), (None,)], [(1,), (2,)], [(1,), (1,)]):
        with pytest.raises(ValueError):
            asm.checked_labels(spark.createDataFrame(bad, "oov_label int"), "x")
    with pytest.raises(ValueError):
        asm.checked_labels(df.withColumnRenamed("oov_label", "other"), "x")
    origins = spark.createDataFrame([("from_fit",), ("kb_match",), ("oov",), (None,)], "o string")
    assert [r[0] for r in origins.select(asm.known_origin(F.col("o"))).collect()] == [1, 1, 0, 0]


def test_frames(spark):
    a = spark.createDataFrame([(1, "e", 3, "m"), (2, "f", -1, "n"), (3, "g", None, "o")], "row_id long, entity string, cluster int, mention string")
    at = spark.createDataFrame([(1, [0.5, 0.25]), (2, [1.0, 2.0])], "row_id long, at array<double>")
    assert [tuple(r) for r in asm.placed_assignments(a, at, "row_id", 2).collect()] == [(1, "e", 3, "m", 0.5, 0.25)]
    assert asm.placed_assignments(a, at, "row_id", 2, exclude_noise=False).count() == 2
    both = asm.aligned({"x": a, "y": a.drop("mention")}, ["row_id"], ["mention"]).orderBy("part", "row_id").collect()
    assert [r["mention"] for r in both] == ["m", "n", "o", None, None, None]
    grid = spark.createDataFrame([("m", 1, 0.5, "x")], "layer string, min_cluster_size int, dbcv double, extra string").withColumn("model", F.lit("k"))
    assert asm.in_export_order(grid).columns == ["model", "layer", "min_cluster_size", "dbcv", "extra"]
    parts = asm.combination_parts(spark.createDataFrame([("fusion2", "a/1,2+b/3"), ("bert", "1"), ("fusion3", "")], "model string, layer string")).collect()
    assert [(r["arity"], r["base_models"], r["layer_code"]) for r in parts] == [("fusion2", ["a", "b"], "1,2,3"), ("singleton", ["bert"], "1"), ("fusion3", ["fusion3"], "")]
    stem = spark.createDataFrame([("fusion2", "a/1+b/2")], "m string, l string").select(asm.file_stem(F.col("m"), F.col("l"))).first()[0]
    assert stem == "fusion2_a_1__b_2"
    curves = asm.grid_curves(spark.createDataFrame([("m", "1", 20, 0.5, 0.1, 3), ("m", "1", 10, 0.4, 0.2, 5)], "model string, layer string, min_cluster_size int, dbcv double, ari double, n_clusters int")).first()
    assert [p["min_cluster_size"] for p in json.loads(curves["json"])] == [10, 20]


def test_draws_sources_and_inputs(spark):
    df = spark.range(7).select(F.col("id").alias("row_id"), F.lit("e").alias("entity"), F.array(F.lit(1.0)).alias("embed"))
    assert asm.draw_rows(df, 3).count() == 3
    counts = [r["count"] for r in asm.draw_rows(df, 17).groupBy("row_id").count().collect()]
    assert sorted(counts) == [2, 2, 2, 2, 3, 3, 3]
    assert asm.draw_rows(df.limit(0), 5).count() == 0
    assert asm.aligned_sources([df, df], ["row_id"]).count() == 7
    with pytest.raises(ValueError):
        asm.aligned_sources([df, df.where("row_id < 3")], ["row_id"])
    assert asm.paths_by_combination([("m", "1", "p"), ("n", "2", "q")], [("n", "2")]) == ["q"]
    with pytest.raises(ValueError):
        asm.paths_by_combination([], [("n", "2")])
    assert sorted(r["orig_idx"] for r in asm.screener_inputs(df, "e").collect()) == list(range(7))
    assert asm.screener_frame(df, 3, "neg", 1).count() == 3 and asm.screener_frame(df, None, "neg", 1).count() == 7
    assert asm.screener_frame(df, None, "neg", 1, df.limit(2)).count() == 2
    p = spark.createDataFrame([(2, 0.5), (-1, 0.1), (99, 0.2)], "mention_source_index long, score double")
    assert [r["score"] for r in asm.with_predictions(df.select("row_id"), p, "row_id", ["score", "none"]).orderBy("row_id").collect()] == [None, None, 0.5, None, None, None, None]


def test_numbering_over_ranges(spark):
    n = 5000
    df = spark.range(n).select((F.col("id") * 7919 % n).alias("k")).repartition(6)
    got = numbered_rows(df, ["k"], "i").collect()
    assert all(r["k"] == r["i"] for r in got) and len(got) == n
    assert numbered_rows(df.limit(0), ["k"], "i").count() == 0
    assert T.LongType() == numbered_rows(df, ["k"], "i").schema["i"].dataType
