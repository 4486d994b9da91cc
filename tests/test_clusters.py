"""Composition, grids and metrics on literal cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossweave.operators import composition as comp
from glossweave.operators import grid as gr
from glossweave.operators import learning as ln
from glossweave.operators import metrics as mx


def assignments(spark, pairs):
    rows = [(e, c) for e, c, n in pairs for _ in range(n)]
    return spark.createDataFrame([(i, e, c) for i, (e, c) in enumerate(rows)], "row_id long, entity string, cluster int")


def test_composition(spark):
    df = assignments(spark, [("a", 0, 10), ("b", 0, 10), ("a", 1, 90), ("b", 1, 10)])
    got = {(r["cluster"], r["entity"]): (round(r["within"], 6), round(r["capture"], 6)) for r in comp.composition(df).collect()}
    assert got == {(0, "a"): (0.5, 0.1), (0, "b"): (0.5, 0.5), (1, "a"): (0.9, 0.9), (1, "b"): (0.1, 0.5)}


def test_weights_and_other(spark):
    w = {(r["row_id"]): r["weight"] for r in comp.with_entity_weights(assignments(spark, [("a", 0, 2), ("b", 0, 1)])).collect()}
    assert w == pytest.approx({0: 1 / math.sqrt(2), 1: 1 / math.sqrt(2), 2: 1.0})
    rows = comp.composition_table(assignments(spark, [(e, 0, 1) for e in "abcd"]), 2).collect()
    assert len(rows) == 3 and sum(r["mass"] for r in rows) == pytest.approx(4) and {r["entity"] for r in rows} == {"a", "b", "Other (2 terms)"}
    many = assignments(spark, [("a", c, 1) for c in range(10)])
    assert comp.composition_table(many, 2, 3).select("cluster").distinct().count() == 3
    assert comp.top_clusters(comp.entity_mass(many), 0).count() == 10


def test_names(spark):
    c = spark.createDataFrame([(0, "a", 0.5), (0, "b", 0.5), (1, "x", 0.95), (1, "y", 0.05), (2, "x", 0.93), (2, "y", 0.07), (-1, "z", 1.0), (3, "q", 1.0)], "cluster int, entity string, within double")
    assert {r["cluster"]: r["name"] for r in comp.consensus_names(c).collect()} == {0: "a-b", 1: "x_A", 2: "x_B", -1: "noise", 3: "q"}
    a = spark.createDataFrame([("i", 1), ("j", -1), ("k", 0)], "entity_id string, cluster int")
    assert {tuple(r) for r in comp.derived_labels(a, c).collect()} == {("i", "x / y"), ("j", "noise"), ("k", "a / b")}


def test_modes_and_summary(spark):
    df = assignments(spark, [("a", 3, 2), ("a", 1, 2), ("a", -1, 9), ("b", -1, 1)])
    assert {tuple(r) for r in comp.modal_cluster(df).collect()} == {("a", 1)}
    assert tuple(comp.mass_summary(df).first()) == (14, 2, 10, pytest.approx(10 / 14))
    assert tuple(comp.mass_summary(df.limit(0)).first()) == (0, 0, 0, 0.0)


def grid(spark, rows):
    return spark.createDataFrame(rows, "min_cluster_size int, icm double, n_clusters int, dbcv double, ari double")


def test_grid_aggregate(spark):
    r = gr.aggregate_grid(grid(spark, [(10, 1.0, 2, 0.5, 0.3), (10, 1.0, 4, 0.7, 0.5), (20, 1.0, 3, float("nan"), 0.1)])).orderBy("min_cluster_size").collect()
    assert r[0]["dbcv_mean"] == pytest.approx(0.6) and r[0]["ari_mean"] == pytest.approx(0.4) and r[0]["dbcv_count"] == 2 and r[0]["dbcv_std"] == pytest.approx(math.sqrt(0.02))
    assert r[1]["dbcv_mean"] is None and r[1]["ari_std"] == 0.0


def curve(spark, ys, std=None):
    rows = [(10 + 5 * i, y, (std or [0.0] * len(ys))[i], 3, None, None, 0, 3.0) for i, y in enumerate(ys)]
    return spark.createDataFrame(rows, "min_cluster_size int, dbcv_mean double, dbcv_std double, dbcv_count long, ari_mean double, ari_std double, ari_count long, n_clusters_mean double")


def test_plateau(spark):
    r = gr.solve_sizes(curve(spark, [0.1, 0.2, 0.5, 1.5, 2.0, 2.01, 2.0]), [], plateau=0.9, tolerance=0.2).first()
    assert r["selection"] == "plateau_derivative" and r["chosen"] in (25, 30, 35)
    r = gr.solve_sizes(curve(spark, [0.1, 0.3, 0.5, 0.7, 0.9]), [], tolerance=1e-9, window=1).first()
    assert r["selection"] == "smoothed_argmax" and r["chosen"] == 30
    r = gr.solve_sizes(curve(spark, [0.2, 0.9, 1.0], [0.05, 0.9, 0.01]), [], method="lower_bound", window=1).first()
    assert r["chosen"] == 20
    with pytest.raises(ValueError):
        gr.objective(F.lit(1.0), F.lit(1.0), F.lit(1), "best")


def test_gradient_and_smoothing_match_numpy(spark):
    import numpy as np

    x, y = [1.0, 2.0, 4.0, 7.0, 8.0], [1.0, 3.0, 2.0, 5.0, 4.0]
    df = spark.createDataFrame(list(zip(x, y)), "x double, y double")
    got = [r["dy"] for r in gr.gradient(df, "y", "x", [], "dy").orderBy("x").collect()]
    assert got == pytest.approx(list(np.gradient(y, x)))
    got = [r["s"] for r in gr.smooth(df, "y", "x", 3, [], out="s").orderBy("x").collect()]
    assert got == pytest.approx([2.0, 2.0, 10 / 3, 11 / 3, 4.5])


def test_fusions_and_leaders(spark):
    s = spark.createDataFrame([("a", "1", 0.8), ("b", "1", 0.7), ("c", "1", 0.1), ("a+b", "1", 0.9)], "model string, layer string, score double")
    top = gr.fusion_candidates(s.where("model <> 'a+b'"), 2, 1).first()
    assert top["members"] == "a/1+b/1" and top["score"] == pytest.approx(1.5)
    assert {r["model"]: r["overall"] for r in gr.leaderboard(s).collect()} == {"a": True, "b": False, "c": False}
    with pytest.raises(ValueError):
        gr.fusion_candidates(s, 4, 1)


def test_rank_statistics(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1)], "y int, s double")
    assert mx.auc(df, "y", "s").first()["auc"] == pytest.approx(0.875)
    assert mx.auc(df.where("y = 1"), "y", "s").first()["auc"] == 0.5
    c = mx.curve(df, "y", "s").orderBy(F.desc("threshold")).collect()
    assert [(r["tp"], r["fp"]) for r in c] == [(1, 0), (2, 1), (2, 2)]
    assert mx.best_f1(mx.curve(df, "y", "s")).first()["threshold"] == 0.5
    r = mx.binary_metrics(df.limit(0), "y", "s", []).first()
    assert (r["precision"], r["recall"], r["f1"]) == (0.0, 0.0, 0.0)


def test_adjusted_rand(spark):
    same = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), ("b", 2), (None, 2)], "e string, c int")
    assert mx.adjusted_rand(same, "e", "c").first()["ari"] == pytest.approx(1.0)
    assert mx.adjusted_rand(same.limit(0), "e", "c").first()["ari"] == 0.0


def test_pair_deviation_matches_pairs(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 4))
    rows = [(i, "g" if i < 50 else "h", x[i].tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "row_id long, g string, v array<double>")
    got = {r["g"]: (r["n_pairs"], r["std"]) for r in mx.cosine_deviation(df, "g", "v", "row_id", 4).collect()}
    old, mx._GROUP_ROWS = mx._GROUP_ROWS, 7
    try:
        split = {r["g"]: (r["n_pairs"], r["std"]) for r in mx.cosine_deviation(df, "g", "v", "row_id", 4).collect()}
    finally:
        mx._GROUP_ROWS = old
    for name, at in (("g", slice(0, 50)), ("h", slice(50, 60))):
        u = x[at] / np.linalg.norm(x[at], axis=1, keepdims=True)
        c = (u @ u.T)[np.triu_indices(len(u), 1)]
        for g in (got, split):
            assert g[name][0] == len(c) and g[name][1] == pytest.approx(c.std(ddof=1))


def test_operating_points_match_brute_force(spark):
    rows = [(i % 2, i / 10, (i * 7 % 20) / 2) for i in range(40)]
    df = spark.createDataFrame(rows, "y int, r double, m double")
    got = mx.operating_points(df, "y", "r", "m", 1.5, 2.0).orderBy("point").collect()
    assert len(got) == 120
    for p in (0, 37, 80, 119):
        b = 2.0 - 10 + p * 16 / 119
        said = [y for y, r, m in rows if 1.5 * r + b - m > 0]
        assert got[p]["precision"] == pytest.approx(sum(said) / len(said) if said else 0.0)
        assert got[p]["recall"] == pytest.approx(sum(said) / 20)


def test_labels_of_all_rows_from_a_fitted_sample(spark):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(size=(60, 3)) * 0.1 + c for c in ((0, 0, 0), (5, 5, 5))])
    rows = [(i, v.tolist(), f"e{i // 60}") for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "row_id long, u array<double>, entity string")
    sample = df.where("row_id % 2 = 0")
    fitted = ln.cluster_sample(sample, "row_id", "u", 5).join(sample.select("row_id", "u"), "row_id")
    got = {r["row_id"]: r for r in ln.nearest_fitted(df, fitted, "row_id", "u").collect()}
    assert len(got) == 120 and all(r["is_fitted"] == (i % 2 == 0) for i, r in got.items())
    assert len({got[i]["cluster"] for i in range(60)}) == 1 and {got[0]["cluster"], got[60]["cluster"]} == {0, 1}
    grid = ln.whole_size_grid(df, sample, "row_id", "u", "entity", [5, 500], 3).collect()
    assert [(r["min_cluster_size"], r["n_clusters"], round(r["ari"], 6)) for r in grid] == [(5, 2, 1.0)]
    assert ln.nearest_fitted(df.limit(0), fitted, "row_id", "u").count() == 0
    nothing = ln.nearest_fitted(df, fitted.limit(0), "row_id", "u").collect()
    assert {r["cluster"] for r in nothing} == {-1} and not any(r["is_fitted"] for r in nothing)
