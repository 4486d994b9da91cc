"""Key profiles and balanced lookups."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossweave.functions.keys import article_key, entity_key, proper_entities
from glossweave.operators.skew import heavy_light_lookup, key_profile


def test_keys(spark):
    rows = [(" mrl:000465", "PMID:11034740"), ("__Negative__", "0011326556"), ("negative", "11355730\t"), (None, None), ("--", "11298355.0"), ("é1", "pmid 7"), ("x", "12.5"), ("y", "abc"), ("z", "")]
    got = spark.createDataFrame(rows, "e string, p string").select(entity_key("e"), article_key("p")).collect()
    assert [r[0] for r in got] == ["mrl000465", "negative", "negative", None, None, "é1", "x", "y", "z"]
    assert [r[1] for r in got] == [11034740, 11326556, 11355730, None, 11298355, 7, None, None, None]


def test_proper_entities(spark):
    kb = spark.createDataFrame([("MRL.1",)], "entity_id string")
    ext = spark.createDataFrame([("mrl-1",), ("MRX.2",)], "entity_id string")
    assert {tuple(r) for r in proper_entities(kb, ext).collect()} == {("mrl1", "MRL.1"), ("mrx2", "MRX.2"), ("negative", "__NEGATIVE__")}


def brute(rows):
    out = {}
    for k in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == k]
        x = sorted(r[1] for r in own if r[1] is not None and not math.isnan(r[1]))
        top = Counter(x)
        mode = min((v for v in top if top[v] == max(top.values())), default=None)
        qs = [float(np.quantile(x, q)) if x else None for q in (0.25, 0.5, 0.75)]
        out[k] = (len(own), len({r[2] for r in own if r[2] is not None}), len(x), sum(x) / len(x) if x else None, mode, *qs)
    return out


def test_profile_against_brute_force(spark):
    r = random.Random(3)
    hot = ["hot"] * 700 + ["warm"] * 200 + [f"k{i}" for i in range(40)] + [None] * 9
    value = lambda: r.choice([None, float("nan"), 0.0, -0.0, 1e300, -5.5, *[round(r.gauss(0, 3), 2) for _ in range(6)]])
    rows = [(k, value(), r.choice([None, "a", "b", f"d{r.randrange(50)}"])) for k in hot]
    rows += rows[:100]  # repeated rows
    df = spark.createDataFrame(rows, "key string, v double, s string").withColumns({"m": F.lit("clash"), "w": F.lit(1), "bin": F.lit("x")})
    got = {x["key"]: x for x in key_profile(df, "key", {"v": F.col("v")}, {"s": F.col("s")}).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    for k, (n, nd, nv, mean, mode, *qs) in want.items():
        g = got[k]
        assert (g["n_rows"], g["n_s"], g["n_v"]) == (n, nd, nv)
        for a, b in zip((g["mean_v"], g["mode_v"], g["q25_v"], g["q50_v"], g["q75_v"]), (mean, mode, *qs)):
            assert a == b or a == pytest.approx(b, rel=1e-9)


def test_profile_of_a_narrow_range(spark):
    """All values of the hot key share a bin, which is divided until windows are small."""
    r = random.Random(8)
    rows = [("hot" if i % 3 else "cold", 1.0 + r.randrange(5000) * 1e-9, None) for i in range(3000)] + [("hot", 1.0 + 7e-9, None)] * 400
    df = spark.createDataFrame(rows, "key string, v double, s string")
    got = {x["key"]: x for x in key_profile(df, "key", {"v": F.col("v")}, {"s": F.col("s")}, bin_values=3).collect()}
    for k, (*_, mean, mode, q25, q50, q75) in brute(rows).items():
        assert [got[k][f"{c}_v"] for c in ("mode", "q25", "q50", "q75")] == pytest.approx([mode, q25, q50, q75], abs=1e-15)


def test_profile_of_nothing_and_of_nulls(spark):
    empty = spark.createDataFrame([], "key string, v double, s string")
    assert key_profile(empty, "key", {"v": F.col("v")}, {"s": F.col("s")}).collect() == []
    nulls = spark.createDataFrame([("a", None, None)], "key string, v double, s string")
    row = key_profile(nulls, "key", {"v": F.col("v")}, {"s": F.col("s")}).first()
    assert row["n_rows"] == 1 and row["n_v"] == 0 and row["n_s"] == 0 and row["mean_v"] is None and row["q50_v"] is None
    with pytest.raises(ValueError):
        key_profile(nulls, "key", {"v": F.col("v")}, {}, [1.5])


def test_lookup_splits_hot_keys(spark):
    facts = spark.range(150_000).select(F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, 7).otherwise(F.col("id")).cast("long").alias("k"), "id")
    look = spark.createDataFrame([(7, "seven"), (8, "eight")], "k long, v string")
    left, inner = heavy_light_lookup(facts, look, "k"), heavy_light_lookup(facts, look, "k", "inner")
    assert left.count() == 150_000 and left.where("v = 'seven'").count() == 50_000 and left.where("v = 'eight'").count() == 1
    assert inner.count() == 50_001
    with pytest.raises(ValueError):
        heavy_light_lookup(facts, look, "k", "outer")
