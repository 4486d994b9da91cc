"""Mentions from texts, knowledge-base matches and the link path."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossweave.functions import text as tx
from glossweave.tables import spread

#: Widths of the embedded windows (trap X22: four-word labels never match).
WIDTHS = (1, 2, 3)
_STRETCH = 50_000


def text_chunks(docs: DataFrame, doc: str, text: str, most: int) -> DataFrame:
    """(doc, ichunk, chunk, start): pieces of every text with the running sum of their lengths."""
    parts = docs.select(F.col(doc).alias("doc"), F.posexplode(tx.chunks(text, most)).alias("ichunk", "chunk"))
    before = Window.partitionBy("doc").orderBy("ichunk").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("doc", F.col("ichunk").cast("long").alias("ichunk"), "chunk", F.coalesce(F.sum(F.length("chunk")).over(before), F.lit(0)).alias("start"))


def mention_windows(docs: DataFrame, doc: str, text: str, widths: tuple[int, ...] = WIDTHS, with_text: bool = False) -> DataFrame:
    """(doc, wg, a, b, mention, lemma): token windows of every text that may be a mention.

    ``with_text`` adds the whole text to each window, for what is looked up in it on the spot.
    """
    toks = spread(docs.select(F.col(doc).alias("doc"), F.col(text).alias("text")), "doc").select("doc", "text", tx.tokens("text").alias("toks"))

    def of_width(w: int) -> Column:
        kept = F.filter(tx.windows(F.col("toks"), w), tx.keeps)
        return F.transform(kept, lambda t: F.struct(F.lit(w).alias("wg"), F.element_at(t, 1)["ix"].alias("a"), F.element_at(t, -1)["ix_end"].alias("b"), tx.lemma_key(t).alias("lemma")))

    one = [of_width(w) for w in widths]
    rows = toks.select("doc", "text", F.inline(F.concat(*one)))
    return rows.select("doc", "wg", "a", "b", F.col("text").substr(F.col("a") + 1, F.col("b") - F.col("a")).alias("mention"), "lemma", *(["text"] if with_text else []))


def mentions_in_place(win: DataFrame) -> DataFrame:
    """(same, n): how many windows with their ``text`` have as mention what stands there from ``a`` to ``b``.

    The mention is looked for from ``a`` on in its own text, so no window meets its text by a shuffle. A second
    substring would be the mention's own expression, and the optimiser would take the comparison away.
    """
    same = (F.length("mention") == F.col("b") - F.col("a")) & (F.expr("locate(mention, text, a + 1)") == F.col("a") + 1)
    return win.groupBy(same.alias("same")).agg(F.count(F.lit(1)).alias("n"))


def lemma_index(kb: DataFrame) -> DataFrame:
    """(wg, lemma, label): labels of 1 to 3 words by their lemmas; the smaller label of a shared lemma (J10, trap X13)."""
    keyed = kb.where("label IS NOT NULL").select("label", tx.word_grouping("label").alias("wg"), tx.lemma_key(tx.tokens("label")).alias("lemma"))
    return keyed.where(f"wg <= {max(WIDTHS)} AND lemma <> ''").groupBy("wg", "lemma").agg(F.min("label").alias("label"))


def lemma_matches(win: DataFrame, index: DataFrame) -> DataFrame:
    """Windows that match a label by width and lemma (J9). The plan chooses between broadcast and shuffle by size."""
    return win.join(index, ["wg", "lemma"])


def negatives(win: DataFrame, positives: DataFrame, ratio: float, seed: int = 0) -> DataFrame:
    """Per text round(ratio * positives) windows that match no label, in the order of a seeded hash (S21, traps X5, X21)."""
    keys = ["doc", "wg", "a", "b"]
    want = positives.groupBy("doc").agg(F.bround(F.lit(ratio) * F.count(F.lit(1))).cast("long").alias("k"))
    free = win.join(positives.select(*keys), keys, "left_anti").dropDuplicates(keys).join(want, "doc")
    rank = F.row_number().over(Window.partitionBy("doc").orderBy(F.pmod(F.col("doc") * 31 + F.col("a") * 7919 + F.col("wg") * 104729 + seed, F.lit(10007)), "a", "wg"))
    return free.withColumn("r", rank).where("r <= k").drop("r", "k")


def corpus_mentions(docs: DataFrame, doc: str, text: str, kb: DataFrame, negative: str, ratio: float = 1.0, seed: int = 0) -> DataFrame:
    """(doc, entity, mention, a, b, wg): matches of the knowledge base and sampled negatives (Q9 up to the encoder, S22)."""
    win = mention_windows(docs, doc, text)
    pos = lemma_matches(win, lemma_index(kb))
    neg = negatives(win, pos, ratio, seed)
    cols = ["doc", "mention", "a", "b", "wg"]
    return pos.select(F.col("label").alias("entity"), *cols).unionByName(neg.select(F.lit(negative).alias("entity"), *cols))


def interval(df: DataFrame) -> DataFrame:
    """The frame with ``x`` and ``y``: document-wide positions, else local ones, else null."""
    x, y = F.coalesce("a_abs", "a"), F.coalesce("b_abs", "b")
    return df.withColumns({"x": F.when(y.isNotNull(), x), "y": F.when(x.isNotNull(), y)})


def overlap_islands(df: DataFrame, doc: str, score: str, row_id: str) -> DataFrame:
    """The best row of each group of transitively overlapping mentions of a document (W10, traps X24, X25).

    Best is the highest score, then the shortest span, then the smaller mention, then the smaller row id.
    Rows without positions stay, touching spans don't overlap.
    """
    df = interval(df)
    placed = df.where(F.col("x").isNotNull() & F.col(doc).isNotNull())
    return best_of_islands(placed, doc, score, row_id).unionByName(df.where(F.col("x").isNull() | F.col(doc).isNull()))


def best_of_islands(placed: DataFrame, doc: str, score: str, row_id: str, extent: tuple[str, str] = ("x", "y")) -> DataFrame:
    """``overlap_islands`` of rows that all have a document, ``x`` and ``y``.

    Where a row stands for a whole group that was found beforehand, ``extent`` names the columns with the group's
    first and last position.
    """
    lo, hi = extent
    by = Window.partitionBy(doc).orderBy(lo, hi, row_id)
    reach = F.max(hi).over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = placed.withColumn("new", F.when(reach.isNull() | (F.col(lo) >= reach), 1).otherwise(0))
    island = F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0))
    best = F.row_number().over(Window.partitionBy(doc, "island").orderBy(F.desc(score), F.greatest(F.col("y") - F.col("x"), F.lit(0)), "mention", row_id))
    return marked.withColumn("island", island).withColumn("r", best).where("r = 1").drop("new", "island", "r")


def text_islands(text: np.ndarray, x: np.ndarray, y: np.ndarray, score: np.ndarray, alone: np.ndarray, mention: Callable[[int], str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the best spans of each group of transitively overlapping ones of a text, and the group's first and last position.

    Spans are in the order of text, ``x``, ``y``. Best as in ``overlap_islands``, without its last rule: spans that
    are equal up to their row ids are all given. In texts marked ``alone`` no span is in a group with another.
    """
    if not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    apart = text * (int(y.max()) + 1)  # one axis on which no two texts meet
    new = np.ones(len(x), bool)
    new[1:] = (x + apart)[1:] >= np.maximum.accumulate(y + apart)[:-1]
    new |= alone[text]
    group = np.cumsum(new) - 1
    starts = np.nonzero(new)[0]
    lo, hi = x[starts], np.maximum.reduceat(y, starts)
    order = np.lexsort((y - x, -score, group))
    first = order[np.searchsorted(group[order], np.arange(len(starts)))][group]
    tied = (score == score[first]) & (y - x == (y - x)[first])
    for g in np.nonzero(np.bincount(group[tied]) > 1)[0]:
        stop = starts[g + 1] if g + 1 < len(starts) else len(x)
        rows = [r for r in range(starts[g], stop) if tied[r]]
        names = [mention(r) for r in rows]
        for r, m in zip(rows, names):
            tied[r] = m == min(names)
    keep = np.nonzero(tied)[0]
    return keep, lo[group[keep]], hi[group[keep]]


def cluster_entities(assignments: DataFrame) -> DataFrame:
    """(cluster, entity_id): the first identifier in order ``ord`` assigned to each cluster (J12, trap X9)."""
    return assignments.groupBy("cluster").agg(F.min(F.struct("ord", "entity_id"))["entity_id"].alias("entity_id"))


def gate(df: DataFrame, assignments: DataFrame, threshold: float, is_oov: Column) -> DataFrame:
    """Predicted mentions of real, mapped clusters that pass the screen and the threshold."""
    kept = df.where(~F.coalesce(is_oov, F.lit(False)) & (F.col("cluster") != -1) & (F.coalesce("score", F.lit(0.0)) >= threshold))
    return kept.join(cluster_entities(assignments), "cluster")


def override_labels(approximate: DataFrame, exact: DataFrame, row_id: str) -> DataFrame:
    """Approximate clusters, replaced by the fitted ones where there are any."""
    e = exact.select(row_id, F.col("cluster").alias("__fit"))
    return approximate.join(e, row_id, "left").withColumn("cluster", F.coalesce("__fit", "cluster")).drop("__fit")


def validate(predictions: DataFrame, index: DataFrame, labels: DataFrame) -> DataFrame:
    """Predictions with the label of their lemma and of their identifier and whether these agree."""
    by_lemma = predictions.join(index.withColumnRenamed("label", "lemma_label"), ["wg", "lemma"], "left")
    both = by_lemma.join(labels.select("entity_id", F.col("label").alias("predicted_label")), "entity_id", "left")
    return both.withColumn("is_kb_match", F.coalesce(F.col("lemma_label") == F.col("predicted_label"), F.lit(False)))


def public_view(df: DataFrame) -> DataFrame:
    """Public columns with document-wide positions."""
    return df.select("itext", "mention", F.coalesce("a_abs", "a").alias("a"), F.coalesce("b_abs", "b").alias("b"), "entity_id", "score")


def with_context(df: DataFrame, texts: DataFrame, before: int = 5, after: int = 5) -> DataFrame:
    """Mentions (doc, a, b) with the words around them; an empty string without a text.

    A text's mentions are gathered by stretches of ``_STRETCH`` characters, so each stretch splits its text once
    however many mentions it has, and no row holds more mentions than a stretch has.
    """
    marks = F.struct("a", "b", *[c for c in df.columns if c not in ("doc", "a", "b")])
    per = df.groupBy("doc", F.floor(F.coalesce("a", F.lit(0)) / _STRETCH).alias("__at")).agg(F.collect_list(marks).alias("__m"))
    joined = per.join(texts.select("doc", F.col("text").alias("__text")), "doc", "left")
    found = joined.withColumn("__c", tx.contexts("__text", F.transform("__m", lambda m: F.struct(m["a"].cast("int").alias("a"), m["b"].cast("int").alias("b"))), before, after))
    return found.select("doc", F.explode(F.arrays_zip("__m", "__c")).alias("x")).select("doc", "x.__m.*", F.col("x.__c").alias("context")).select(*df.columns, "context")
