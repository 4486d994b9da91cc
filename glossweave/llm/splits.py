"""Train, validation and test splits that keep tied records together.

Records that share an article or an entity, also by way of others, form a group. Groups are the trees
of a spanning forest built by minimum-edge contraction; whole groups are dealt to the splits.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossweave.operators.skew import heavy_light_lookup
from glossweave.tables import drop_materialised, materialise, materialise_counted

#: Size bands in each power of two.
BANDS = 4
_BUCKETS = 1024


@dataclass
class Forest:
    """``edges`` (a, b): the persisted spanning forest over articles. ``labels`` (node, root): every node that has an edge."""

    edges: DataFrame
    labels: DataFrame


def entity_anchors(ties: DataFrame) -> DataFrame:
    """(ekey, anchor): the smallest article of every entity."""
    return ties.groupBy("ekey").agg(F.min("article").alias("anchor"))


def spanning_forest(edges: DataFrame, max_rounds: int = 64, keep: str | None = None) -> Forest:
    """Contract an undirected graph along minimum edges until no edge is left.

    ``edges`` has two long columns ``a`` and ``b``; loops and repeated edges are allowed. In each round
    every component picks its smallest incident edge under one total order of edges (a hash of the
    pair, then the pair), so picks can only form trees with one mutual pair each; the smaller end of
    that pair becomes the root. Picks are hash aggregations with map-side minima, so that a hub's edges
    never meet in one task unreduced, and lookups of a hub go through ``heavy_light_lookup``, whose row
    counts are taken once a round. Each round at least halves the components that still have edges, and
    every round's picks are written to the shared folder: together they are the forest, which is written
    to ``keep`` for later use if that is given. The rounds' maps are composed from the last to the first,
    so the full node set is joined only once.
    """
    work, n_edges = materialise_counted(
        edges.where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct().withColumns({"oa": F.col("lo"), "ob": F.col("hi")}),
        "edges",
    )
    picked, maps = [], []
    for _ in range(max_rounds):
        if not n_edges:
            break
        edge = F.struct(F.xxhash64("lo", "hi").alias("w"), "lo", "hi", "oa", "ob")
        ends = work.select(edge.alias("e"), F.explode(F.array("lo", "hi")).alias("node"))
        pick, n_nodes = materialise_counted(ends.groupBy("node").agg(F.min("e").alias("e")).select("node", "e.lo", "e.hi", "e.oa", "e.ob"), "picks")
        picked.append(pick.select(F.col("oa").alias("a"), F.col("ob").alias("b")))
        # a pick that both ends share makes the smaller end a root
        other = F.when(F.col("node") == F.col("lo"), F.col("hi")).otherwise(F.col("lo"))
        up = pick.select("node", other.alias("up"))
        back = up.select(F.col("node").alias("up"), F.col("up").alias("up2"))
        ptr = heavy_light_lookup(up, back, "up", "inner", n_nodes).select(
            "node", F.when((F.col("up2") == F.col("node")) & (F.col("node") < F.col("up")), F.col("node")).otherwise(F.col("up")).alias("up")
        )
        ptr = materialise(ptr, "up")
        moved = 1
        while moved:
            above = ptr.select(F.col("node").alias("up"), F.col("up").alias("up2"))
            step = heavy_light_lookup(ptr.select("node", "up"), above, "up", "inner", n_nodes)
            before = ptr
            ptr, moved = materialise_counted(step.select("node", F.col("up2").alias("up"), (F.col("up2") != F.col("up")).alias("moved")), "up", "moved")
            drop_materialised(before)
        ptr = ptr.select("node", "up")
        maps.append(ptr)
        lo = ptr.select(F.col("node").alias("lo"), F.col("up").alias("rlo"))
        hi = ptr.select(F.col("node").alias("hi"), F.col("up").alias("rhi"))
        moved_edges = heavy_light_lookup(heavy_light_lookup(work, lo, "lo", "inner", n_edges), hi, "hi", "inner", n_edges).where("rlo <> rhi")
        pair = (F.least("rlo", "rhi").alias("lo"), F.greatest("rlo", "rhi").alias("hi"))
        nxt, n_edges = materialise_counted(
            moved_edges.select(*pair, F.struct("oa", "ob").alias("o")).groupBy("lo", "hi").agg(F.min("o").alias("o")).select("lo", "hi", "o.oa", "o.ob"), "edges"
        )
        drop_materialised(work)
        work = nxt
    else:
        raise RuntimeError(f"edges left after {max_rounds} rounds")
    spark = edges.sparkSession
    if not maps:
        none = spark.createDataFrame([], "a long, b long")
        return Forest(none, spark.createDataFrame([], "node long, root long"))
    labels = maps[-1]
    for m in reversed(maps[:-1]):
        rest = labels.select(F.col("node").alias("up"), F.col("up").alias("top"))
        labels = heavy_light_lookup(m, rest, "up", "left").select("node", F.coalesce("top", "up").alias("up"))
    forest = picked[0]
    for p in picked[1:]:
        forest = forest.unionByName(p)
    forest = forest.distinct()
    if keep:
        forest.write.mode("overwrite").parquet(keep)
        forest = spark.read.parquet(keep)
    return Forest(forest, labels.select("node", F.col("up").alias("root")))


def tie_groups(ties: DataFrame, keep: str | None = None) -> tuple[DataFrame, Forest]:
    """(article, group_article): every article with the smallest article it is tied to, and the forest.

    ``ties`` has ``ekey`` (any type) and ``article`` (long). Rows with a null in either tie nothing.
    Entities are contracted first: each is replaced by edges from its articles to its smallest article,
    which leaves a graph of articles alone. An article without ties is its own group; an empty table
    gives none. ``keep`` names a folder for the forest that outlives the session.
    """
    ties, n_ties = materialise_counted(ties.where("ekey IS NOT NULL AND article IS NOT NULL").select("ekey", "article").distinct(), "ties")
    star = heavy_light_lookup(ties, entity_anchors(ties), "ekey", "inner", n_ties).select(F.col("anchor").alias("a"), F.col("article").alias("b"))
    forest = spanning_forest(star, keep=keep)
    nodes = ties.select(F.col("article").alias("node")).distinct()
    roots, n_roots = materialise_counted(nodes.join(forest.labels, "node", "left").select(F.col("node").alias("article"), F.coalesce("root", "node").alias("root")), "roots")
    least = roots.groupBy("root").agg(F.min("article").alias("group_article"))
    return heavy_light_lookup(roots, least, "root", "inner", n_roots).select("article", "group_article"), forest


def _plan_bands(bands: list[tuple[int, int, int]], shares: list[float]) -> list[list[int]]:
    """How many groups of every band (band, groups, rows) go to each split, larger sizes first.

    A band is dealt in the proportions of what the splits still lack, rounded by largest remainders.
    """
    total = sum(n for _, _, n in bands)
    lack, out = [total * p for p in shares], []
    for _, k, n in bands:
        open_ = [max(0.0, x) for x in lack]
        want = [k * x / sum(open_) if sum(open_) > 0 else k * p for x, p in zip(open_, shares)]
        deal = [int(w) for w in want]
        for j in sorted(range(len(shares)), key=lambda j: (deal[j] - want[j], -lack[j], j))[: k - sum(deal)]:
            deal[j] += 1
        lack = [x - d * n / k for x, d in zip(lack, deal)]
        out.append(deal)
    return out


def group_splits(groups: DataFrame, shares: Mapping[str, float], seed: int = 0) -> DataFrame:
    """(gid, n, split): whole groups dealt to splits in proportion to their rows.

    ``groups`` has ``gid`` (string) and ``n`` (rows). Groups are stratified by size band (``BANDS`` in each power
    of two, so there are at most some hundred). Bands are planned from the largest sizes down, each in the
    proportions that the splits still lack; within a band groups are dealt systematically in the order of a
    seeded hash: a split that gets a of k groups takes every k/a-th. Positions come from counts per (band,
    hash bucket), so that no task orders a whole band.
    """
    names, total_share = list(shares), sum(shares.values())
    if not names or min(shares.values()) < 0 or abs(total_share - 1) > 1e-9:
        raise ValueError("shares must be non-negative and sum to 1")
    spark = groups.sparkSession
    placed = groups.select(
        "gid", F.col("n").cast("long").alias("n"), F.floor(F.log2("n") * BANDS).cast("int").alias("band"), F.xxhash64(F.lit(seed), "gid").alias("h")
    ).withColumn("bucket", F.pmod("h", F.lit(_BUCKETS)).cast("int"))
    counts = placed.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
    counts = materialise(counts, "bands")
    bands = [(r["band"], r["k"], r["n"]) for r in counts.groupBy("band").agg(F.sum("k").alias("k"), F.sum("n").alias("n")).orderBy(F.desc("band")).collect()]
    plan = spark.createDataFrame([(b, k, d) for (b, k, _), d in zip(bands, _plan_bands(bands, [shares[x] for x in names]))], "band int, size long, deal array<long>")
    before = Window.partitionBy("band").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("band", "bucket", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("start"))
    rank = F.row_number().over(Window.partitionBy("band", "bucket").orderBy("h", "gid")) - 1
    placed = placed.withColumn("r", rank).join(F.broadcast(offsets.join(plan, "band")), ["band", "bucket"]).withColumn("i", F.col("start") + F.col("r"))
    # systematic dealing: the last split takes a of the k positions evenly, the one before it takes its part of those left
    i, left, split = F.col("i"), F.col("size"), F.lit(names[0])
    rules = []
    for j in reversed(range(1, len(names))):
        a = F.element_at("deal", j + 1)
        upto, here = F.floor((i + 1) * a / left), F.floor(i * a / left)
        rules.append((F.coalesce(upto > here, F.lit(False)), names[j]))
        i, left = i - upto, F.nullif(left - a, F.lit(0))
    for takes, name in reversed(rules):
        split = F.when(takes, F.lit(name)).otherwise(split)
    return placed.select("gid", "n", split.alias("split"))


def assign_splits(rows: DataFrame, row_id: str, article: str, entity: str, shares: Mapping[str, float], seed: int = 0) -> DataFrame:
    """(row_id, split) for every row: no article and no entity is found in two splits.

    ``article`` (long) and ``entity`` (string) may be null; pass null for labels that must tie nothing.
    A row with neither is a group of its own. Extra columns are ignored. Repeated rows come out as often
    as they came in.
    """
    base = rows.select(F.col(row_id).alias("__id"), F.col(article).alias("article"), F.col(entity).alias("ekey"))
    ties = base.select("ekey", "article")
    groups, _ = tie_groups(ties)
    groups = materialise(groups, "groups")
    anchors = entity_anchors(ties.where("ekey IS NOT NULL AND article IS NOT NULL"))
    by_entity = anchors.join(groups, F.col("anchor") == F.col("article")).select(F.concat(F.lit("e"), "ekey").alias("unit"), F.concat(F.lit("g"), "group_article").alias("gid"))
    by_article = groups.select(F.concat(F.lit("a"), "article").alias("unit"), F.concat(F.lit("g"), "group_article").alias("gid"))
    unit = F.coalesce(F.concat(F.lit("a"), "article"), F.concat(F.lit("e"), "ekey"))
    found = heavy_light_lookup(base.withColumn("unit", unit), by_article.unionByName(by_entity), "unit", "left")
    found, n = materialise_counted(found.select("__id", F.coalesce("gid", "unit", F.concat(F.lit("r"), F.coalesce(F.col("__id").cast("string"), F.lit("")))).alias("gid")), "units")
    dealt = group_splits(found.groupBy("gid").agg(F.count(F.lit(1)).alias("n")), shares, seed)
    return heavy_light_lookup(found, dealt.select("gid", "split"), "gid", "inner", n).select(F.col("__id").alias(row_id), "split")
