"""Filling containers of fixed capacity by linear grouping and best fit, planned on a histogram of sizes."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossweave.tables import materialise

#: One token: a longest run of letters, digits and underscores, or of other characters that are not white space.
TOKEN_PATTERN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}\x{85}\x{1c}-\x{1f}]+"
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_BUCKETS = 256
#: Items larger than capacity / LARGE_PART are grouped; GROUPS classes of equal cardinality.
LARGE_PART, GROUPS = 8, 48


def token_count(c: Column | str) -> Column:
    """Number of tokens of a text; null for null."""
    return F.regexp_count(F.col(c) if isinstance(c, str) else c, F.lit(TOKEN_PATTERN)).cast("long")


def _pattern(rest: dict[int, int], capacity: int) -> dict[int, int]:
    """A configuration with the largest size left, filled up as far as possible (larger sizes first on ties)."""
    sizes = sorted((s for s, k in rest.items() if k), reverse=True)
    first, room = sizes[0], capacity - sizes[0]
    best: list[tuple[int, ...] | None] = [None] * (room + 1)
    best[0] = ()
    for s in sizes:
        if s > room:
            continue
        for _ in range(min(rest[s] - (s == first), room // s)):
            grew = False
            for w in range(room, s - 1, -1):
                if best[w] is None and best[w - s] is not None and best[w - s].count(s) < rest[s] - (s == first):
                    best[w], grew = (*best[w - s], s), True
            if not grew:
                break
    full = max(w for w in range(room + 1) if best[w] is not None)
    out: dict[int, int] = defaultdict(int)
    for s in (first, *best[full]):
        out[s] += 1
    return dict(out)


def plan_packing(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Containers for ``histogram`` items of each size (1 to ``capacity``), and how many there are.

    The plan is a list of (size, rank_from, rank_to, container): the item of that size with rank r goes
    to container + r - rank_from. Large sizes are rounded up within groups of equal cardinality, and
    configurations of these few sizes are chosen by filling the container of the largest size left as
    full as they can. The actual items then take the places of their group, and small ones go, largest
    first, to the container with the least room that still holds them. All of it counts runs of equal
    containers, so the work depends on the capacity and not on the number of items.
    """
    if any(not 0 < s <= capacity for s in histogram):
        raise ValueError("sizes must be from 1 to the capacity")
    plan: list[tuple[int, int, int, int]] = []
    n_containers, used = 0, defaultdict(int)
    whole = histogram.get(capacity, 0)
    if whole:
        plan.append((capacity, 0, whole, 0))
        n_containers = whole
    large = [(s, histogram[s]) for s in sorted(histogram, reverse=True) if capacity > s > capacity // LARGE_PART and histogram[s]]
    small = [(s, histogram[s]) for s in sorted(histogram, reverse=True) if s <= capacity // LARGE_PART and histogram[s]]

    # groups: runs (size, rank_from, count) of about equal cardinality, named by their largest size
    each = -(-sum(k for _, k in large) // GROUPS) or 1
    groups: dict[int, list[list[int]]] = {}
    rest: dict[int, int] = {}
    name, room = 0, 0
    for s, k in large:
        while k:
            if not room or not name:
                if s in groups:  # one size fills several groups
                    name, room = s, each
                else:
                    name, room = s, each
                    groups[s], rest[s] = [], 0
            take = min(k, room)
            groups[name].append([s, used[s], take])
            used[s] += take
            rest[name] += take
            k, room = k - take, room - take
            if not room:
                name = 0

    rooms: dict[int, list[tuple[int, int]]] = defaultdict(list)
    while any(rest.values()):
        config = _pattern(rest, capacity)
        times = min(rest[s] // m for s, m in config.items())
        slots = []
        for s, m in config.items():
            rest[s] -= m * times
            for _ in range(m):  # the next ``times`` items of the group, as runs of equal size
                need, runs = times, []
                while need:
                    run = groups[s][0]
                    take = min(need, run[2])
                    runs.append((run[0], run[1], take))
                    run[1], run[2], need = run[1] + take, run[2] - take, need - take
                    if not run[2]:
                        groups[s].pop(0)
                slots.append(runs)
        marks = {0, times}
        for runs in slots:
            at = 0
            for size, first, take in runs:
                plan.append((size, first, first + take, n_containers + at))
                at += take
                marks.add(at)
        edges = sorted(marks)
        for x, y in zip(edges, edges[1:]):
            load = 0
            for runs in slots:
                at = 0
                for size, _, take in runs:
                    if at <= x < at + take:
                        load += size
                    at += take
            rooms[capacity - load].append((n_containers + x, n_containers + y))
        n_containers += times

    for s, k in small:
        rank = 0
        while rank < k:
            fit = min((r for r, runs in rooms.items() if r >= s and runs), default=None)
            if fit is None:
                per = capacity // s
                times = (k - rank) // per
                if times:  # whole containers of this size
                    for _ in range(per):
                        plan.append((s, rank, rank + times, n_containers))
                        rank += times
                    rooms[capacity - per * s].append((n_containers, n_containers + times))
                    n_containers += times
                else:
                    rooms[capacity].append((n_containers, n_containers + 1))
                    n_containers += 1
                continue
            a, b = rooms[fit].pop()
            take = min(b - a, k - rank)
            plan.append((s, rank, rank + take, a))
            rank += take
            rooms[fit - s].append((a, a + take))
            if a + take < b:
                rooms[fit].append((a + take, b))
    return plan, n_containers


def token_pieces(docs: DataFrame, doc_id: str, text: str, capacity: int) -> DataFrame:
    """(doc_id, piece_no, n_tokens, a, b): every text as one item, or in pieces of ``capacity`` tokens if it has more.

    ``a`` and ``b`` are the characters of a piece, from its first token to the next piece's first token (or
    to the end). Texts without a token, and null texts, take no space and give no row.
    """
    sized = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).withColumn("n", token_count("text")).where("n > 0")
    fits = sized.where(F.col("n") <= capacity).select("id", F.lit(1).cast("long").alias("piece_no"), F.col("n").alias("n_tokens"), F.lit(0).cast("long").alias("a"), F.length("text").cast("long").alias("b"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, t in zip(pdf["id"], pdf["text"]):
                starts = [m.start() for m in _TOKEN.finditer(t)]
                firsts = [0, *starts[capacity::capacity], len(t)]
                for k in range(len(firsts) - 1):
                    rows.append((i, k + 1, min(capacity, len(starts) - k * capacity), firsts[k], firsts[k + 1]))
            yield pd.DataFrame(rows, columns=["id", "piece_no", "n_tokens", "a", "b"])

    kind = docs.schema[doc_id].dataType.simpleString()
    divided = sized.where(F.col("n") > capacity).select("id", "text").mapInPandas(cut, f"id {kind}, piece_no long, n_tokens long, a long, b long")
    return fits.unionByName(divided)


def pack_texts(docs: DataFrame, doc_id: str, text: str, capacity: int = 1024) -> DataFrame:
    """(doc_id, piece_no, n_tokens, a, b, container): every text in a container of ``capacity`` tokens.

    Only a text of more than ``capacity`` tokens is divided, into the fewest pieces. The histogram of item
    sizes, at most ``capacity`` rows, is what the driver plans on; items find their place by their rank
    among the items of their size, from counts per (size, hash bucket), so that a frequent size is spread
    over many tasks. Null and empty texts give no row; repeated rows are packed each on their own.
    """
    items = materialise(token_pieces(docs, doc_id, text, capacity), "items")
    histogram = {r["n_tokens"]: r["k"] for r in items.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("k")).collect()}
    plan, _ = plan_packing(histogram, capacity)
    # runs in the order of size and rank; the plan has as many as there are runs of equal containers, whatever the number of texts
    runs = np.array(sorted((size, lo, first) for size, lo, _, first in plan), np.int64).reshape(-1, 3)
    ends = np.searchsorted(runs[:, 0], np.arange(capacity + 2))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, rank = (b.column(k).to_numpy() for k in (2, 5))
            at = np.empty(len(size), np.int64)
            for s in np.unique(size):
                on = size == s
                at[on] = ends[s] + np.searchsorted(runs[ends[s] : ends[s + 1], 1], rank[on], "right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(runs[at, 2] + rank - runs[at, 1])], ["id", "piece_no", "n_tokens", "a", "b", "container"])

    keyed = items.withColumn("bucket", F.pmod(F.xxhash64("id", "piece_no"), F.lit(_BUCKETS)).cast("int"))
    counts = keyed.groupBy("n_tokens", "bucket").agg(F.count(F.lit(1)).alias("k"))
    before = Window.partitionBy("n_tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("n_tokens", "bucket", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("start"))
    rank = F.row_number().over(Window.partitionBy("n_tokens", "bucket").orderBy("id", "piece_no")) - 1
    ranked = keyed.withColumn("r", rank).join(starts, ["n_tokens", "bucket"]).withColumn("rank", F.col("start") + F.col("r"))
    kind = docs.schema[doc_id].dataType.simpleString()
    held = ranked.select("id", "piece_no", "n_tokens", "a", "b", "rank").mapInArrow(place, f"id {kind}, piece_no long, n_tokens long, a long, b long, container long")
    return held.withColumnRenamed("id", doc_id)
