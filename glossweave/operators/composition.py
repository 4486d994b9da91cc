"""What clusters are made of: weighted mass, composition, names, assignments, catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossweave.operators.skew import heavy_light_lookup

NOISE = -1


def emergent(df: DataFrame) -> DataFrame:
    """Rows of real clusters: neither noise nor unassigned."""
    return df.where(F.col("cluster").isNotNull() & (F.col("cluster") != NOISE))


def count_emergent(df: DataFrame) -> DataFrame:
    """One row: the exact number of clusters other than noise (A10)."""
    return df.agg(F.count_distinct(F.when(F.col("cluster") != NOISE, F.col("cluster"))).alias("n_clusters"))


def with_entity_weights(df: DataFrame) -> DataFrame:
    """The frame with ``weight`` = 1 / sqrt(rows of its entity) (A9). The counts are aggregated first, so no window holds a hot entity."""
    counts = df.groupBy("entity").agg((1 / F.sqrt(F.count(F.lit(1)))).alias("weight"))
    return heavy_light_lookup(df, counts, "entity", "inner")


def entity_mass(df: DataFrame, weighted: bool = True, exclude_noise: bool = True) -> DataFrame:
    """(cluster, entity, mass): summed weights, which are taken after noise is dropped (A8, trap X19)."""
    rows = (emergent(df) if exclude_noise else df.where(F.col("cluster").isNotNull())).where("entity IS NOT NULL")
    n = rows.groupBy("cluster", "entity").agg(F.count(F.lit(1)).alias("n"))
    if not weighted:
        return n.select("cluster", "entity", F.col("n").cast("double").alias("mass"))
    total = F.sum("n").over(Window.partitionBy("entity"))
    return n.select("cluster", "entity", (F.col("n") / F.sqrt(total)).alias("mass"))


def _ranked(c: str) -> Column:
    return F.round(c, 9)


def top_clusters(mass: DataFrame, most: int | None) -> DataFrame:
    """(cluster, total): the clusters of the largest mass; all of them when ``most`` is None or not positive (T1, trap X11)."""
    totals = mass.groupBy("cluster").agg(F.sum("mass").alias("total"))
    return totals if most is None or most <= 0 else totals.orderBy(_ranked("total").desc(), "cluster").limit(most)


def top_n_and_other(mass: DataFrame, n: int) -> DataFrame:
    """(cluster, entity, mass): the ``n`` heaviest entities of each cluster and one row for the others."""
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(_ranked("mass").desc(), "entity"))
    ranked = mass.withColumn("r", rank)
    top = ranked.where(F.col("r") <= n).select("cluster", "entity", "mass")
    rest = ranked.where(F.col("r") > n).groupBy("cluster").agg(F.count(F.lit(1)).alias("k"), F.sum("mass").alias("mass"))
    return top.unionByName(rest.select("cluster", F.format_string("Other (%d terms)", "k").alias("entity"), "mass"))


def composition_table(df: DataFrame, n: int, most_clusters: int | None = None, weighted: bool = True) -> DataFrame:
    """Mass, top clusters, top entities with a remainder (T3, trap X15: order by cluster id)."""
    mass = entity_mass(df, weighted)
    kept = top_clusters(mass, most_clusters).select("cluster")
    return top_n_and_other(mass.join(F.broadcast(kept) if most_clusters else kept, "cluster", "left_semi"), n)


def limit_flow(table: DataFrame, most_clusters: int = 48, most_entities: int = 24) -> DataFrame:
    """Of a composition table the heaviest clusters, and in them the heaviest entities and all remainder rows."""
    kept = table.join(top_clusters(table, most_clusters).select("cluster"), "cluster", "left_semi")
    other = F.col("entity").startswith("Other (")
    tops = kept.where(~other).groupBy("entity").agg(F.sum("mass").alias("m")).orderBy(_ranked("m").desc(), "entity").limit(most_entities)
    return kept.where(other).unionByName(kept.where(~other).join(tops.select("entity"), "entity", "left_semi").select(kept.columns))


def composition(df: DataFrame) -> DataFrame:
    """(cluster, entity, n, within, capture): shares of the cluster and of the entity, noise included (A7, traps X19, X20)."""
    n = df.where(F.col("cluster").isNotNull() & F.col("entity").isNotNull()).groupBy("cluster", "entity").agg(F.count(F.lit(1)).alias("n"))
    share = lambda k: F.col("n") / F.sum("n").over(Window.partitionBy(k))
    return n.select("cluster", "entity", "n", share("cluster").alias("within"), share("entity").alias("capture"))


def mass_summary(df: DataFrame) -> DataFrame:
    """Rows, clusters, noise rows and their share; 0 for an empty frame."""
    rows = df.where("cluster IS NOT NULL")
    noise = F.count(F.when(F.col("cluster") == NOISE, 1))
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct(F.when(F.col("cluster") != NOISE, F.col("cluster"))).alias("n_clusters"),
        noise.alias("n_noise"),
        F.coalesce(F.try_divide(noise.cast("double"), F.count(F.lit(1))), F.lit(0.0)).alias("noise_fraction"),
    )


def modal_cluster(df: DataFrame) -> DataFrame:
    """(entity, cluster): the most frequent cluster but noise, the smallest on ties (A12, trap X14)."""
    n = emergent(df).where("entity IS NOT NULL").groupBy("entity", "cluster").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("entity").agg((-F.max(F.struct("n", (-F.col("cluster")).alias("c")))["c"]).cast("int").alias("cluster"))


def provisional_assignments(labels: DataFrame, df: DataFrame) -> DataFrame:
    """(entity_id, cluster) of ``labels`` (entity_id, entity); identifiers without rows are left out."""
    return labels.join(modal_cluster(df), "entity").select("entity_id", "cluster")


def consensus_names(comp: DataFrame, noise: str = "noise", tolerance: float = 0.15, least_share: float = 0.52, least_gap: float = 0.12) -> DataFrame:
    """(cluster, name): one entity's name, a leading entity's name, or the sorted names joined; duplicates get letters.

    A mixture is flat when its shares differ by at most min(tolerance, 0.5 / entities); a leader holds
    ``least_share`` and is ``least_gap`` ahead. Past 26 duplicates the letters run on in code order (trap X35).
    """
    rows = comp.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct((-F.col("within")).alias("f"), "entity"))).alias("e"))
    first, second = F.element_at("e", 1), F.try_element_at("e", F.lit(2))
    joined = F.array_join(F.array_sort(F.transform("e", lambda x: x["entity"])), "-")
    flat = F.element_at("e", -1)["f"] - first["f"] <= F.least(F.lit(tolerance), F.lit(0.5) / F.size("e"))
    leads = (-first["f"] >= least_share) & (F.coalesce(second["f"], F.lit(0.0)) - first["f"] >= least_gap)
    name = F.when(F.col("cluster") == NOISE, F.lit(noise)).when(F.size("e") == 1, first["entity"]).when(flat, joined).when(leads, first["entity"]).otherwise(joined)
    named = rows.select("cluster", name.alias("name"))
    w = Window.partitionBy("name")
    letter = F.char(F.row_number().over(w.orderBy("cluster")) + 64)
    return named.select("cluster", F.when(F.count(F.lit(1)).over(w) > 1, F.concat("name", F.lit("_"), letter)).otherwise(F.col("name")).alias("name"))


def derived_labels(assignments: DataFrame, comp: DataFrame, least: float = 0.05, n: int = 3, noise: str = "noise") -> DataFrame:
    """(entity_id, name): a cluster's leading entities of at least ``least``, at most ``n``, else the first one."""
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("within"), "entity"))
    top = comp.withColumn("r", rank).where((F.col("r") <= n) & ((F.col("within") >= least) | (F.col("r") == 1)))
    names = top.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("r", "entity"))).alias("e"))
    name = F.when(F.col("cluster") == NOISE, F.lit(noise)).otherwise(F.array_join(F.transform("e", lambda x: x["entity"]), " / "))
    return assignments.join(names.select("cluster", name.alias("name")), "cluster").select("entity_id", "name")


def emergent_catalogue(df: DataFrame, n: int = 5, weighted: bool = True) -> DataFrame:
    """(cluster, weighted_mass, mention_count, dominant_fraction, rank, entity, within, capture): top entities of every cluster."""
    mass = entity_mass(df, weighted).groupBy("cluster").agg(F.sum("mass").alias("weighted_mass"))
    comp = composition(df).where(F.col("cluster") != NOISE)
    by = Window.partitionBy("cluster")
    rank = F.row_number().over(by.orderBy(F.desc("within"), "entity"))
    top = comp.select("*", rank.alias("rank"), F.max("within").over(by).alias("dominant_fraction"), F.sum("n").over(by).alias("mention_count")).where(F.col("rank") <= n)
    return top.join(mass, "cluster").select("cluster", "weighted_mass", "mention_count", "dominant_fraction", "rank", "entity", "within", "capture")
