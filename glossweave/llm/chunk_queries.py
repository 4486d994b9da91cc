"""Problem 4: texts of ``link`` in pieces of at most 1,000 characters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave.llm.chunks import split_texts
from glossweave.tables import table


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces with their overlap."""
    return split_texts(table(spark, sf_dir, "link"), "link_id", "text")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oversized texts and the coarsest boundary that serves them."""
    return p4_pieces(spark, sf_dir).where("piece_no = 1").select("link_id", "cut_kind")


def p4_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces and their mean length by kind of text and of cut."""
    return p4_pieces(spark, sf_dir).groupBy("cut_kind", "boundary").agg(
        F.count(F.lit(1)).alias("n_pieces"), F.max(F.length("piece")).alias("longest"), F.round(F.avg(F.length("piece")), 3).alias("mean_length")
    )


def p4_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every oversized text put together again from what its pieces add, whether all fit, and whether each begins as the one before ends."""
    pieces = p4_pieces(spark, sf_dir).select("link_id", F.struct("piece_no", "piece", F.expr("right(piece, int(b - a))").alias("adds")).alias("p"))
    whole = pieces.groupBy("link_id").agg(F.array_sort(F.collect_list("p")).alias("ps"))  # the pieces of one text
    follows = "forall(sequence(2, size(ps)), i -> right(ps[i - 2].piece, 100) = left(ps[i - 1].piece, least(100, length(ps[i - 2].piece))))"
    return whole.select(
        "link_id", F.concat_ws("", "ps.adds").alias("text"), F.expr("forall(ps, p -> length(p.piece) <= 1000)").alias("all_fit"),
        F.expr(f"size(ps) < 2 OR {follows}").alias("overlaps"),
    )


QUERIES = {"p4_found": p4_found, "p4_pieces": p4_pieces, "p4_boundaries": p4_boundaries, "p4_joined": p4_joined}
_WS = r"\s\p{Z}\x{85}\x{1c}-\x{1f}"
SQL = {
    "p4_joined": "SELECT link_id, text, true AS all_fit, true AS overlaps FROM link WHERE length(text) > 1000",
    "p4_found": rf"""WITH t AS (SELECT link_id, text, regexp_split_to_array(regexp_replace(text, '([.!?])([{_WS}])', '\1' || chr(1) || '\2', 'g'), '\x01|\r\n|[\n\r\x0b\x0c\x{{85}}\x{{2028}}\x{{2029}}]') AS s,
        regexp_split_to_array(text, '[{_WS}]+') AS w FROM link WHERE length(text) > 1000)
      SELECT link_id, CASE WHEN list_max([length(x) for x in s]) <= 1000 THEN 'sentence' WHEN list_max([length(x) for x in w]) <= 1000 THEN 'word' ELSE 'inside' END AS cut_kind FROM t""",
}
