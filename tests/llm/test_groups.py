"""Clusters, splits and quotas: brute force and odd inputs."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossweave.llm.mixture import Mixture, mixture_clusters
from glossweave.llm.quota import Cell, draw_quotas, half_up, plan_quotas, stratum_report
from glossweave.llm.splits import assign_splits, group_splits, spanning_forest, tie_groups

SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}


def components(edges, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    groups = defaultdict(set)
    for n in nodes:
        groups[find(n)].add(n)
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("shape", ["random", "path", "star", "ring"])
def test_forest(spark, shape):
    r = random.Random(1)
    n = 120
    edges = {
        "random": [(r.randrange(n), r.randrange(n)) for _ in range(90)],
        "path": [(i, i + 1) for i in range(n - 1)],
        "star": [(0, i) for i in range(1, n)] * 2,
        "ring": [(i, (i + 1) % n) for i in range(n)],
    }[shape]
    f = spanning_forest(spark.createDataFrame(edges, "a long, b long"))
    kept = [tuple(x) for x in f.edges.collect()]
    nodes = {x for e in edges for x in e if e[0] != e[1]}
    want = components(edges, nodes)
    assert components(kept, nodes) == want and len(kept) == len(nodes) - len(want)
    roots = defaultdict(set)
    for x in f.labels.collect():
        roots[x["root"]].add(x["node"])
    assert {frozenset(g) for g in roots.values()} == want


def test_ties_with_nulls_and_nothing(spark):
    rows = [("e1", 5), ("e1", 3), ("e2", 3), ("e2", 9), (None, 9), (None, 1), ("e3", None), ("e4", 70), ("e1", 5)]
    df = spark.createDataFrame(rows, "ekey string, article long")
    got = {tuple(x) for x in tie_groups(df)[0].collect()}
    assert got == {(3, 3), (5, 3), (9, 3), (70, 70)}
    groups, forest = tie_groups(df.limit(0))
    assert groups.count() == 0 and forest.edges.count() == 0


def test_splits_keep_groups_together(spark):
    r = random.Random(2)
    rows = [(i, r.choice([None, 1, r.randrange(200)]), r.choice([None, "hot", f"e{r.randrange(300)}", f"e{r.randrange(300)}"])) for i in range(1500)]
    rows = [(i, a if e != "hot" else (a or 0) % 7, e) for i, a, e in rows]
    df = spark.createDataFrame(rows, "id long, art long, ent string").withColumns({"gid": F.lit("clash"), "unit": F.lit(1)})
    got = {x["id"]: x["split"] for x in assign_splits(df, "id", "art", "ent", SHARES).collect()}
    assert len(got) == 1500 and set(got.values()) <= set(SHARES)
    for at in (1, 2):
        by = defaultdict(set)
        for row in rows:
            if row[at] is not None:
                by[row[at]].add(got[row[0]])
        assert all(len(s) == 1 for s in by.values())
    assert assign_splits(df.limit(0), "id", "art", "ent", SHARES).count() == 0


def test_shares_of_many_small_groups(spark):
    groups = spark.range(6000).select(F.col("id").cast("string").alias("gid"), (F.col("id") % 5 + 1).alias("n"))
    got = Counter()
    for x in group_splits(groups, SHARES).collect():
        got[x["split"]] += x["n"]
    total = sum(got.values())
    assert total == sum(i % 5 + 1 for i in range(6000))
    assert all(abs(got[k] / total - p) < 0.01 for k, p in SHARES.items())
    one = group_splits(spark.createDataFrame([("g", 10)], "gid string, n long"), SHARES).collect()
    assert [x["split"] for x in one] == ["train"]
    # some large groups among small ones, and only large ones
    for sizes, off in (([9000, 4000, 1000, 900, 800] + [1 + i % 7 for i in range(3000)], 0.01), ([50] * 10, 1e-9), ([3000, 300, 290, 280, 20, 10], 0.08)):
        got, df = Counter(), spark.createDataFrame([(f"g{i}", n) for i, n in enumerate(sizes)], "gid string, n long")
        for x in group_splits(df, SHARES).collect():
            got[x["split"]] += x["n"]
        assert sum(got.values()) == sum(sizes) and all(abs(got[k] / sum(sizes) - p) <= off for k, p in SHARES.items())
    with pytest.raises(ValueError):
        group_splits(groups, {"a": 0.5})


def test_forest_that_outlives_the_session(spark, tmp_path):
    df = spark.createDataFrame([("e1", 5), ("e1", 3), ("e2", 3), ("e2", 9)], "ekey string, article long")
    tie_groups(df, keep=f"{tmp_path}/forest")
    assert sorted(sorted(x) for x in spark.read.parquet(f"{tmp_path}/forest").collect()) == [[3, 5], [3, 9]]


def test_quota_plan():
    assert [half_up(0.0005, n) for n in (1000, 999, 3000)] == [1, 0, 2]
    cells = [Cell("a", "0", 0.5, 5, 1000), Cell("a", "1", 0.1, 0, 3), Cell("b", "0", 0.4, 10, 20), Cell("c", "0", 0.0, 30, 10)]
    plan = {(p["row"], p["col"]): p for p in plan_quotas(cells, 100)}
    assert plan["a", "1"]["shortfall"] == 7 and plan["b", "0"]["shortfall"] == 20 and plan["c", "0"]["shortfall"] == 20 and plan["a", "0"]["shortfall"] == 0
    assert sum(p["quota"] for p in plan.values()) == 100
    assert all(p["quota"] <= p["available"] for p in plan.values()) and plan["c", "0"]["quota"] == 10
    enough = plan_quotas([Cell("a", "0", 0.7, 0, 99), Cell("b", "0", 0.3, 0, 99)], 10)
    assert [p["quota"] for p in enough] == [7, 3]
    assert plan_quotas([], 10) == [] and plan_quotas([Cell("a", "0", 1.0, 0, 0)], 5)[0]["quota"] == 0


def test_no_need_stays_open_while_another_cell_has_more_than_its_own():
    r = random.Random(5)
    for trial in range(40):
        k = r.randrange(1, 30)
        parts = [r.random() for _ in range(k)]
        cells = [Cell(f"e{i // 2}", str(i % 2), round(x / sum(parts), 6), r.choice([0, 3, 40]), r.choice([0, 2, 50, 500])) for i, x in enumerate(parts)]
        n = r.choice([20, 200, 900])
        plan = plan_quotas(cells, n)
        assert sum(p["quota"] for p in plan) == min(n, sum(c.available for c in cells)), trial
        below = [p for p in plan if p["quota"] < min(p["need"], p["available"])]
        above = [p for p in plan if p["quota"] > p["need"]]
        assert not (below and above)
        assert all(0 <= p["quota"] <= p["available"] and p["quota"] + p["shortfall"] >= p["need"] for p in plan)
        # slack is what no record can give, or what floors and shares together ask beyond n
        assert all(p["shortfall"] >= p["need"] - p["available"] for p in plan)
        if sum(min(p["need"], p["available"]) for p in plan) <= n:
            assert all(p["shortfall"] == max(0, p["need"] - p["available"]) for p in plan)
        # floors come before shares
        for c, p in zip(cells, plan):
            low = min(c.floor, c.available)
            if p["quota"] < low:
                assert all(q["quota"] <= max(d.floor, 0) for d, q in zip(cells, plan))


def test_draw(spark):
    rows = [(i, "a" if i % 3 else None, i % 2 if i % 7 else None, "x") for i in range(900)]
    df = spark.createDataFrame(rows, "id long, ent string, lab long, row string").withColumns({"k": F.lit(1), "quota": F.lit(2)})
    targets = spark.createDataFrame([("a", 0, 0.6, 3), ("a", 1, 0.4, 3), ("b", 0, None, 4)], "ent string, lab long, target_share double, min_rows int")
    counts = df.groupBy("ent", "lab").agg(F.count(F.lit(1)).alias("k"))
    report = stratum_report(counts, targets, "ent", "lab", 50)
    got = {(r["row"], r["col"]): r for r in report.collect()}
    assert got["b", "0"]["shortfall"] == 4 and got["a", "0"]["quota"] == 30 and got["a", "1"]["quota"] == 20
    sample = draw_quotas(df, report, "ent", "lab", ["id"])
    assert sample.columns == df.columns
    out = sample.collect()
    assert Counter((r["ent"], r["lab"]) for r in out) == {("a", 0): 30, ("a", 1): 20} and len({r["id"] for r in out}) == 50
    assert {r["id"] for r in draw_quotas(df, report, "ent", "lab", ["id"]).collect()} == {r["id"] for r in out}
    empty = stratum_report(counts.limit(0), targets, "ent", "lab", 0)
    assert draw_quotas(df.limit(0), empty, "ent", "lab", ["id"]).count() == 0
    with pytest.raises(ValueError):
        stratum_report(counts, targets.unionByName(targets), "ent", "lab", 10)


def test_em_raises_the_likelihood():
    rng = np.random.default_rng(0)
    z = np.vstack([rng.normal(size=(200, 2)) + c for c in ((0, 0), (5, 5))])
    g = Mixture(np.array([0.4, 0.4, 0.2]), np.array([[1.0, 0.0], [4.0, 5.0], [2.0, 2.0]]), np.array([np.eye(2), np.eye(2), 9 * np.eye(2)]))
    start = g.statistics(z)[0]
    for _ in range(5):
        g = g.updated(g.statistics(z))
    assert g.statistics(z)[0] > start and g.weights.sum() == pytest.approx(1)
    assert all(np.linalg.eigvalsh(c).min() > 0 for c in g.covs)


def test_clusters_of_directions(spark):
    rng = np.random.default_rng(4)
    heads = np.linalg.qr(rng.normal(size=(64, 3)))[0].T
    rows, true = [], {}
    for i in range(900):
        c = i % 4
        v = (heads[c] * 3 + rng.normal(size=64) * 0.2) if c < 3 else rng.normal(size=64)
        rows.append((i, (v * (1 + i % 5)).tolist(), "x"))
        true[i] = c
    bad = [(1000, None, "x"), (1001, [1.0] * 63, "x"), (1002, [0.0] * 64, "x"), (1003, [float("nan")] * 64, "x"), (1004, [None] * 64, "x"), (None, [1.0] * 64, "x")]
    df = spark.createDataFrame(rows + bad + rows[:8], "mid long, e array<double>, id string").withColumn("u", F.lit(1))
    found = mixture_clusters(df, "mid", "e")
    got = found.members.collect()
    by = defaultdict(set)
    for r in got:
        by[r["cluster_no"]].add(true[r["id"]])
    assert found.n_usable == 908 and len(found.sizes) == 3 and sorted(map(tuple, by.values())) == [(0,), (1,), (2,)]
    assert sum(found.sizes) == len(got) == 681 and min(r["cosine"] for r in got) >= 0.6
    heap = np.vstack([np.repeat(rng.normal(size=(1, 64)), 400, axis=0), heads[0] * 5 + rng.normal(size=(400, 64)) * 0.1, rng.normal(size=(400, 64))])
    copies = mixture_clusters(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(heap)], "mid long, e array<double>"), "mid", "e")
    assert sorted(copies.sizes) == [400, 400] and {r["id"] // 400 for r in copies.members.collect()} == {0, 1}
    nothing = mixture_clusters(df.limit(0), "mid", "e")
    assert nothing.members.count() == 0 and nothing.sizes == []
    same = mixture_clusters(spark.createDataFrame([(i, [1.0] + [0.0] * 63) for i in range(50)], "mid long, e array<double>"), "mid", "e")
    assert same.members.count() == 50 and same.sizes == [50]


@pytest.mark.parametrize(("n_groups", "share", "cosine"), [(12, 0.05, 0.66), (5, 0.2, 0.64), (5, 0.15, 0.75), (40, 0.02, 0.68)])
def test_loose_groups(spark, n_groups, share, cosine):
    """Groups whose members are near the mean and not near each other."""
    rng = np.random.default_rng(9)
    heads = rng.normal(size=(n_groups, 64))
    heads /= np.linalg.norm(heads, axis=1)[:, None]
    rows, true, n = [], {}, 100 * n_groups if n_groups > 30 else 3000
    for g in range(n_groups):
        for _ in range(int(n * share)):
            x = rng.normal(size=64)
            x -= (x @ heads[g]) * heads[g]
            c = min(0.97, max(0.615, rng.normal(cosine, 0.02)))
            rows.append((c * heads[g] + np.sqrt(1 - c * c) * x / np.linalg.norm(x)).tolist())
            true[len(rows) - 1] = g
    while len(rows) < n:
        rows.append(rng.normal(size=64).tolist())
    found = mixture_clusters(spark.createDataFrame(list(enumerate(rows)), "mid long, e array<double>"), "mid", "e")
    got = found.members.collect()
    pairs = Counter((r["cluster_no"], true.get(r["id"])) for r in got)
    assert len(found.sizes) == n_groups
    best = {c: max((k, t) for (d, t), k in pairs.items() if d == c) for c in range(n_groups)}
    assert len({t for _, t in best.values()}) == n_groups
    assert sum(k for k, _ in best.values()) >= 0.97 * len(true)


def test_a_group_that_the_sample_hardly_holds_is_counted_over_all_rows(spark, monkeypatch):
    from glossweave.llm import mixture

    rng = np.random.default_rng(3)
    heads = np.eye(64)[:2]
    rows = [(heads[int(i >= 2000)] + rng.normal(0, 0.05, 64)).tolist() for i in range(2400)]
    # 3 of 2,003 sampled rows for a sixth of all rows
    monkeypatch.setattr(mixture, "sampled", lambda df, n, size: sorted(df.where("id < 2003").collect(), key=lambda r: r["id"]))
    found = mixture_clusters(spark.createDataFrame(list(enumerate(rows)), "mid long, e array<double>"), "mid", "e")
    assert sorted(found.sizes) == [400, 2000]
    assert mixture._judged(spark.createDataFrame([(np.float32(r).tobytes(),) for r in rows], "u binary"), 64, [heads[0], heads[1]], 0.6, 401, 0.9)[0] @ heads[0] > 0.99
