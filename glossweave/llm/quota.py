"""Samples that follow target shares, with floors, by min-cost flow over cell counts."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Target tables are collected to plan the quotas; more strata than this are refused.
MAX_STRATA = 20_000
_BUCKETS = 4096
#: Prices of a unit. A record sent is worth more than any path costs, a need met is worth more than a missing
#: record costs, a missing record costs more than any margin or excess can save, and one missing to a floor most.
_SENT, _NEED, _NO_FLOOR, _NO_TARGET, _OVER_MARGIN, _EXCESS, _STEPS = -100_000, -10_000, 5_000, 1_000, 20, 10, 10


class MinCostFlow:
    """Cheapest flow by the primal-dual method, with integer capacities and prices.

    Each phase finds the cheapest paths and then fills all of them at once, so there are as many phases as
    there are different path prices and not as many as there are arcs.
    """

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.cap: list[int] = []
        self.cost: list[int] = []

    def arc(self, a: int, b: int, cap: int, cost: int) -> int:
        """Add an arc and its reverse; the arc's number."""
        k = len(self.to)
        for x, y, c, w in ((a, b, cap, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.cap.append(c)
            self.cost.append(w)
        return k

    def _prices(self, s: int) -> list[int | None]:
        """The cheapest price of every node from ``s`` (label correcting, as prices may be negative)."""
        dist: list[int | None] = [None] * len(self.out)
        dist[s] = 0
        queue, inside = deque([s]), [False] * len(self.out)
        while queue:
            x = queue.popleft()
            inside[x] = False
            for k in self.out[x]:
                y = self.to[k]
                if self.cap[k] > 0 and (dist[y] is None or dist[x] + self.cost[k] < dist[y]):
                    dist[y] = dist[x] + self.cost[k]
                    if not inside[y]:
                        inside[y] = True
                        queue.append(y)
        return dist

    def _fill(self, s: int, t: int, dist: list[int | None]) -> None:
        """Saturate the cheapest paths from ``s`` to ``t``."""
        at, path, on = [0] * len(self.out), [], [False] * len(self.out)
        x = s
        on[s] = True
        while True:
            if x == t:
                push = min(self.cap[k] for k in path)
                for k in path:
                    self.cap[k] -= push
                    self.cap[k ^ 1] += push
                for i, k in enumerate(path):
                    if not self.cap[k]:  # back to the first arc that is full now
                        for j in path[i:]:
                            on[self.to[j]] = False
                        x = self.to[k ^ 1]
                        del path[i:]
                        break
                continue
            while at[x] < len(self.out[x]):
                k = self.out[x][at[x]]
                y = self.to[k]
                if self.cap[k] > 0 and not on[y] and dist[y] is not None and dist[y] == dist[x] + self.cost[k]:
                    path.append(k)
                    on[y] = True
                    x = y
                    break
                at[x] += 1
            else:
                if x == s:
                    return
                on[x] = False
                k = path.pop()
                x = self.to[k ^ 1]
                at[x] += 1

    def settle(self, s: int, t: int) -> None:
        """Send flow from ``s`` to ``t`` for as long as a unit pays, that is, while its path has a negative price."""
        while True:
            dist = self._prices(s)
            if dist[t] is None or dist[t] >= 0:
                return
            self._fill(s, t, dist)

    def flow(self, k: int) -> int:
        """Units on arc ``k``."""
        return self.cap[k ^ 1]


@dataclass(frozen=True)
class Cell:
    """A stratum of the cross-classification row x column."""

    row: str
    col: str
    share: float
    floor: int
    available: int


def half_up(share: float, n: int) -> int:
    """share * n rounded half up, from the decimal digits of the share."""
    return int((Decimal(repr(float(share))) * n).quantize(Decimal(1), rounding=ROUND_HALF_UP))


def plan_quotas(cells: list[Cell], n: int) -> list[dict]:
    """Integer quotas for each cell, at most what it holds, n in all where possible.

    Records flow from a source of n through row margins to the cells, in each through an arc of its
    availability, and on through column margins to a sink. The arc out of a cell is worth most up to its
    ``need``, the larger of floor and share * n (half up), and dearer with every tenth of the need beyond it,
    so that what other cells lack is made up evenly, within the same row and column first. Slack arcs bring to
    a cell what records can't, at a price above any excess: units on them are the ``shortfall``. A need that
    records could fill is therefore never left open in favour of another cell's excess; where the needs
    together exceed n, shares give way to floors, evenly.
    """
    rows, cols = sorted({c.row for c in cells}), sorted({c.col for c in cells})
    at = {("r", r): 2 + i for i, r in enumerate(rows)} | {("c", c): 2 + len(rows) + i for i, c in enumerate(cols)}
    first_cell = 2 + len(at)
    sink = first_cell + len(cells)
    g = MinCostFlow(sink + 1)
    target = [half_up(c.share, n) for c in cells]
    need = [max(c.floor, t) for c, t in zip(cells, target)]
    source, records, all_units = 0, 1, n + sum(need)
    g.arc(source, records, n, _SENT)
    for kind, names in (("r", rows), ("c", cols)):
        margins = dict.fromkeys(names, 0)
        for c, x in zip(cells, need):
            margins[c.row if kind == "r" else c.col] += x
        for name, margin in margins.items():
            ends = (records, at[kind, name]) if kind == "r" else (at[kind, name], sink)
            g.arc(*ends, margin, 0)
            g.arc(*ends, all_units, _OVER_MARGIN)
    held, slack = [], []
    for i, (c, x) in enumerate(zip(cells, need)):
        cell, col = first_cell + i, at["c", c.col]
        held.append(g.arc(at["r", c.row], cell, c.available, 0))
        low = min(c.floor, x)
        shares = [(x - low) * (j + 1) // _STEPS - (x - low) * j // _STEPS for j in range(_STEPS)]
        slack.append([g.arc(source, cell, m, _NO_TARGET + j) for j, m in enumerate(shares) if m] + [g.arc(source, cell, low, _NO_FLOOR)])
        g.arc(cell, col, x, _NEED)
        left, step = max(0, c.available - x), max(1, x // 10)
        for j in range(_STEPS):
            take = min(step, left) if j < _STEPS - 1 else left
            if take:
                g.arc(cell, col, take, _EXCESS + j)
            left -= take
    g.settle(source, sink)
    return [
        {"row": c.row, "col": c.col, "target": t, "need": x, "available": c.available, "quota": g.flow(h), "shortfall": sum(map(g.flow, ks))}
        for c, t, x, h, ks in zip(cells, target, need, held, slack)
    ]


def stratum_report(counts: DataFrame, targets: DataFrame, row: str, col: str, n: int) -> DataFrame:
    """One row for each target stratum: target, need, available, quota, shortfall.

    ``counts`` has ``row``, ``col`` (null in either: no stratum) and ``k``, the number of records; several rows
    of one stratum add up. ``targets`` has the same two columns, ``target_share`` and ``min_rows``; its rows
    are collected, and refused beyond ``MAX_STRATA``. Null shares and floors count as 0; a stratum that is
    named twice is refused.
    """
    spark = counts.sparkSession
    strata = targets.select(
        F.col(row).cast("string").alias("row"), F.col(col).cast("string").alias("col"),
        F.coalesce("target_share", F.lit(0.0)).alias("share"), F.coalesce("min_rows", F.lit(0)).cast("int").alias("floor"),
    ).where("row IS NOT NULL AND col IS NOT NULL")
    strata_rows = strata.limit(MAX_STRATA + 1).collect()
    if len(strata_rows) > MAX_STRATA or len({(r["row"], r["col"]) for r in strata_rows}) < len(strata_rows):
        raise ValueError("too many strata, or a stratum twice")
    local = spark.createDataFrame([(r["row"], r["col"]) for r in strata_rows], "row string, col string")
    counted = counts.select(F.col(row).cast("string").alias("row"), F.col(col).cast("string").alias("col"), "k").join(F.broadcast(local), ["row", "col"])
    have = {(r["row"], r["col"]): r["k"] for r in counted.groupBy("row", "col").agg(F.sum("k").alias("k")).collect()}
    plan = plan_quotas([Cell(r["row"], r["col"], r["share"], r["floor"], have.get((r["row"], r["col"]), 0)) for r in strata_rows], n)
    schema = "row string, col string, target long, need long, available long, quota long, shortfall long"
    return spark.createDataFrame([tuple(p.values()) for p in plan], schema)


def draw_quotas(records: DataFrame, report: DataFrame, row: str, col: str, keys: list[str], seed: int = 0) -> DataFrame:
    """The rows of ``records`` with the smallest seeded hashes of each stratum, as many as its quota.

    Hash buckets are counted per stratum; whole buckets are taken up to the one in which the quota ends,
    and only that one is ordered. ``keys`` must tell the rows apart. The columns come out unchanged.
    """
    cell = [F.col(row).cast("string").alias("__row"), F.col(col).cast("string").alias("__col")]
    quotas = F.broadcast(report.where("quota > 0").select(F.col("row").alias("__row"), F.col("col").alias("__col"), F.col("quota").alias("__quota")))
    h = F.xxhash64(F.lit(seed), *keys)
    named = records.select("*", *cell, h.alias("__h")).withColumn("__bucket", F.shiftrightunsigned("__h", 52).cast("int"))
    named = named.join(quotas, ["__row", "__col"])
    counts = named.groupBy("__row", "__col", "__bucket").agg(F.count(F.lit(1)).alias("k"), F.first("__quota").alias("quota"))
    run = Window.partitionBy("__row", "__col").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.withColumn("upto", F.sum("k").over(run))
    # the bucket in which each quota ends, one row per stratum
    edge = counts.where("upto >= quota AND upto - k < quota").select("__row", "__col", F.col("__bucket").alias("__edge"), (F.col("quota") - F.col("upto") + F.col("k")).alias("__part"))
    placed = named.join(F.broadcast(edge), ["__row", "__col"])
    whole = placed.where(F.col("__bucket") < F.col("__edge"))
    order = Window.partitionBy("__row", "__col").orderBy("__h", *keys)
    part = placed.where(F.col("__bucket") == F.col("__edge")).withColumn("__r", F.row_number().over(order)).where("__r <= __part")
    return whole.select(records.columns).unionByName(part.select(records.columns))
