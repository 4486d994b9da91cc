"""Most similar vectors through a permutation index.

Every vector is represented by the order of its nearest pivots. Inverted files are keyed by pairs of the
nearest pivots; within a file, candidates are ranked by the footrule distance of their permutations, and the
best are reranked by cosine. Vectors travel as unit directions of 16 bits an element, which keeps cosines to
about 1e-5.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossweave.functions.vectors import unit_rows
from glossweave.llm.sampling import sampled
from glossweave.operators.skew import heavy_light_lookup
from glossweave.tables import materialise

#: Length of the stored permutation prefix.
PREFIX = 8
#: A vector is also posted with its fourth pivot when that one is nearly as close as the third.
NEARLY = 0.015
#: Pivots come from a sample of so many times their number, which is collected.
PIVOT_SAMPLE = 2
#: A pivot that is to own more records than this has them posted by pair of pivots, each pair on its own.
SPLIT_OVER = 65_536
_SPLIT_SAMPLE = 4096
_BLOB_BYTES = 500_000
_FLUSH_BYTES = 16_000_000
_TASK_BYTES = 10_000_000


def n_pivots(n: int) -> int:
    """About 1.6 times the root of the number of vectors, so that files of pivot pairs keep their length as data grow."""
    return 2 ** max(4, round(math.log2(max(1.0, 1.6 * math.sqrt(max(1, n))))))


def _index_type(pivots: int) -> type:
    return np.uint16 if pivots < 65_535 else np.int32


def quantise(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows as 16-bit integers, and a 64-bit identity of each direction."""
    q = np.round(u / np.abs(u).max(axis=1, keepdims=True) * 32767).astype(np.int16)
    wide = np.pad(q, ((0, 0), (0, -q.shape[1] % 4))).view(np.uint64)
    h = np.zeros(len(q), np.uint64)
    for i in range(wide.shape[1]):
        h = (h ^ wide[:, i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return q, h.view(np.int64)


def unpack(q: np.ndarray) -> np.ndarray:
    """Unit rows from ``quantise``'s integers, in single precision."""
    x = q.astype(np.float32)
    return x / np.sqrt((x * x).sum(axis=1, dtype=np.float64)).astype(np.float32)[:, None]


def permutations(u: np.ndarray, pivots: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's ``length`` nearest pivots in order, and their cosines."""
    s = u.astype(np.float32) @ pivots.T
    top = np.argpartition(-s, min(length, s.shape[1] - 1), axis=1)[:, :length]
    v = np.take_along_axis(s, top, 1)
    order = np.lexsort((top, -v), axis=1)
    return np.take_along_axis(top, order, 1).astype(_index_type(len(pivots))), np.take_along_axis(v, order, 1)


def footrule(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Induced footrule distances of permutation prefixes; a pivot outside the other's prefix counts as just behind it."""
    m = rows.shape[1]
    # pivots by their number in this file, so that the table of places does not grow with all pivots
    names, local = np.unique(np.vstack([rows, others]), return_inverse=True)
    local = local.reshape(-1, m)
    place = np.full((len(others), len(names)), m, np.int16)
    np.put_along_axis(place, local[len(rows) :], np.arange(m, dtype=np.int16)[None, :], axis=1)
    out = np.zeros((len(rows), len(others)), np.int16)
    for i in range(m):
        out += np.abs(place[:, local[: len(rows), i]] - np.int16(i)).T
    return out


def _pivots(source: DataFrame, dim: int, n: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct usable directions of a bounded sample of the ``n`` rows, and all its usable directions."""
    rows = sampled(source.select("id", "v"), n, PIVOT_SAMPLE * count)
    if not rows:
        return np.zeros((0, dim), np.float32), np.zeros((0, dim), np.float32)
    u = unit_rows(pa.array([r["v"] for r in rows], pa.list_(pa.float64())), dim)[1].astype(np.float32)
    _, first = np.unique(quantise(u)[1], return_index=True) if len(u) else (None, np.zeros(0, int))
    return u[np.sort(first)][:count], u


def _select(vectors: DataFrame, vector_id: str, vector: str, dim: int) -> DataFrame:
    return vectors.where(F.col(vector_id).isNotNull() & (F.size(vector) == dim)).select(F.col(vector_id).cast("long").alias("id"), F.col(vector).alias("v"))


def _directions(source: DataFrame, dim: int) -> DataFrame:
    """(id, h): the direction of every usable vector."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok, u = unit_rows(b.column(1), dim)
            h = quantise(u)[1] if len(u) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), pa.array(h)], ["id", "h"])

    return source.mapInArrow(name, "id long, h long")


class _Blobs:
    """Posting records kept by bucket and handed out as large binary rows."""

    def __init__(self, buckets: int):
        self.buckets, self.held, self.size = buckets, [], 0

    def add(self, records: np.ndarray) -> None:
        self.held.append(records)
        self.size += records.nbytes

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            r = np.concatenate(self.held)
            # an owner's records share a bucket, unless they are posted by pair
            mixed = (r["key"].astype(np.uint64) * np.uint64(0x9E3779B1) + r["only"].astype(np.uint64) * np.uint64(0x85EBCA77)) if "only" in r.dtype.names else r["key"].astype(np.uint64)
            to = (mixed % np.uint64(self.buckets)).astype(np.int64)
            r, to = r[order := np.argsort(to, kind="stable")], to[order]
            at = np.searchsorted(to, np.arange(self.buckets + 1))
            on = np.nonzero(at[1:] > at[:-1])[0].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(on, pa.int32()), pa.array([r[at[k] : at[k + 1]].tobytes() for k in on], pa.binary())], ["bucket", "blob"])
        self.held, self.size = [], 0


def near_directions(source: DataFrame, dim: int, n: int, k: int, min_cosine: float, candidates: int | None, split_over: int) -> DataFrame:
    """(ha, hb, cosine): for every direction its up to ``k`` nearest others of at least ``min_cosine``, both ways round."""
    pivots, drawn = _pivots(source, dim, n, n_pivots(n))
    count = len(pivots)
    length, ix = min(PREFIX, count), _index_type(count)
    none = np.iinfo(ix).max
    dtype = np.dtype([("key", ix), ("only", ix), ("posted", np.int8), ("h", np.int64), ("perm", ix, PREFIX), ("vec", np.int16, dim)])
    buckets = max(64, -(-n * 3 * dtype.itemsize // _BLOB_BYTES))
    # pivots whose share of the sample makes them own too many records
    owned = np.zeros(count)
    if len(drawn):
        few = drawn[:_SPLIT_SAMPLE]
        for i in range(0, len(few), 512):
            np.add.at(owned, permutations(few[i : i + 512], pivots, length)[0][:, :3].ravel().astype(np.int64), 1)
        owned *= n / len(few)
    split = owned > split_over

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs, seen = _Blobs(buckets), set()
        for b in batches:
            _, u = unit_rows(b.column(1), dim)
            if not len(u):
                continue
            packed, h = quantise(u)
            # copies of a direction are posted once for each partition
            fresh = np.array([x not in seen and not seen.add(x) for x in h.tolist()], dtype=bool)
            if len(seen) > 2_000_000:
                seen.clear()
            packed, h, u = packed[fresh], h[fresh], u[fresh]
            if not len(u):
                continue
            perm, cos = permutations(u, pivots, length)
            full = np.full((len(u), PREFIX), none, ix)
            full[:, :length] = perm
            # pairs of the posted pivots are kept with their smaller pivot: one record serves all files it owns
            posted = np.full(len(u), min(3, length), np.int8)
            if length > 3:
                posted[cos[:, 2] - cos[:, 3] < NEARLY] = 4
            inside = np.where(np.arange(PREFIX)[None, :] < posted[:, None], full.astype(np.int64), -1)
            largest = inside.max(axis=1)

            def records(on: np.ndarray, key: np.ndarray, only) -> np.ndarray:
                r = np.empty(int(on.sum()), dtype)
                r["key"], r["only"], r["posted"], r["h"], r["perm"], r["vec"] = key[on], only if np.isscalar(only) else only[on], posted[on], h[on], full[on], packed[on]
                return r

            for i in range(min(4, length)):
                owns = (inside[:, i] >= 0) & ((inside[:, i] < largest) | (length == 1))
                apart = owns & split[np.where(owns, inside[:, i], 0)] & (length > 1)
                blobs.add(records(owns & ~apart, full[:, i], none))
                for j in range(min(4, length)) if apart.any() else ():
                    blobs.add(records(apart & (inside[:, j] > inside[:, i]), full[:, i], full[:, j]))
            if blobs.size > _FLUSH_BYTES:
                yield from blobs.flush()
        yield from blobs.flush()

    def files(t: pa.Table) -> pa.Table:
        r = np.frombuffer(b"".join(x.as_py() for x in t.column("blob")), dtype=dtype)
        r = r[np.lexsort((r["h"], r["only"], r["key"]))]
        r = r[np.r_[True, (r["key"][1:] != r["key"][:-1]) | (r["only"][1:] != r["only"][:-1]) | (r["h"][1:] != r["h"][:-1])]]
        # the files each record is in: its key with every larger posted pivot, or with one of them (or alone, if there is but one pivot)
        perm, key = r["perm"].astype(np.int64), r["key"].astype(np.int64)
        here = (np.arange(PREFIX)[None, :] < r["posted"][:, None]) & ((perm > key[:, None]) | (count < 2))
        here &= (r["only"] == none)[:, None] | (perm == r["only"].astype(np.int64)[:, None])
        row, at = np.nonzero(here)
        file = key[row] * (count + 1) + perm[row, at]
        order = np.argsort(file, kind="stable")
        row, file = row[order], file[order]
        cuts = np.r_[np.nonzero(np.r_[True, file[1:] != file[:-1]])[0], len(file)]
        out = [_nearest_in_file(r[row[a:b]], k, min_cosine, candidates, length) for a, b in zip(cuts, cuts[1:]) if b - a > 1]
        ha, hb, c = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))
        return pa.table({"ha": pa.array(ha), "hb": pa.array(hb), "cosine": pa.array(c.astype(np.float64))})

    # as many tasks as the postings need, whatever the session's number of shuffle partitions
    tasks = max(source.sparkSession.sparkContext.defaultParallelism, -(-n * 3 * dtype.itemsize // _TASK_BYTES))
    posted = source.select("id", "v").mapInArrow(post, "bucket int, blob binary").repartition(tasks, "bucket")
    found = posted.groupBy("bucket").applyInArrow(files, "ha long, hb long, cosine double")
    return found.groupBy("ha", "hb").agg(F.max("cosine").alias("cosine"))


def first_k(row: np.ndarray, name: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
    """Positions of each row's ``k`` largest cosines, equal ones by the smaller name."""
    order = np.lexsort((name, -c, row))
    starts = np.nonzero(np.r_[True, row[order][1:] != row[order][:-1]])[0] if len(order) else np.zeros(0, int)
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return order[rank < k]


def _nearest_in_file(r: np.ndarray, k: int, min_cosine: float, candidates: int | None, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best ``k`` of each row of one inverted file.

    Candidates are ranked by footrule and reranked by cosine in blocks of ``candidates``; a row goes on to its
    next block for as long as the last one held a vector of at least ``min_cosine``. A file of no more than one
    block, or any file when ``candidates`` is None, is reranked whole.
    """
    g, u, h, perm = len(r), unpack(r["vec"]), r["h"], r["perm"][:, :length]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    whole = candidates is None or g <= candidates + 1
    step = max(1, min(512, 4_000_000 // g))
    for x in range(0, g, step):
        rows = np.arange(x, min(g, x + step))
        hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if whole:
            c = u[rows] @ u.T
            c[np.arange(len(rows)), rows] = -2
            i, j = np.nonzero(c >= min_cosine)
            hits.append((i, j, c[i, j]))
        else:
            f = footrule(perm[rows], perm)
            f[np.arange(len(rows)), rows] = np.iinfo(np.int16).max  # a row itself comes last
            order = np.argsort(f, axis=1, kind="stable")[:, : g - 1]
            active = np.arange(len(rows))
            for at in range(0, g - 1, candidates):
                best = order[active, at : at + candidates]
                c = np.matmul(u[best], u[rows[active]][:, :, None])[:, :, 0]
                i, j = np.nonzero(c >= min_cosine)
                hits.append((active[i], best[i, j], c[i, j]))
                active = active[np.unique(i)]
                if not len(active):
                    break
        i, j, c = (np.concatenate(z) for z in zip(*hits))
        top = first_k(i, h[j], c, k)
        found.append((h[rows[i[top]]], h[j[top]], c[top]))
    return tuple(np.concatenate(z) for z in zip(*found))


def nearest_above(
    vectors: DataFrame, vector_id: str, vector: str, dim: int = 64, k: int = 5, min_cosine: float = 0.95, candidates: int | None = 64, split_over: int = SPLIT_OVER
) -> DataFrame:
    """(id, other, cosine): of every vector's ``k`` most similar others, those of at least ``min_cosine`` that the index finds.

    ``candidates`` is the number of vectors of an inverted file that are reranked by cosine at a time, in the
    order of the footrule distance (None: the whole file, exactly); a pivot that is to own more than
    ``split_over`` records has them spread over its pairs.

    Equal cosines are ordered by the smaller id. Vectors of one direction (copies, or multiples of each
    other) are one entry of the index, with cosine 1 among themselves, and are taken apart again at the
    end: a group of copies adds at most k + 1 ids to any list, so nothing is emitted for all pairs of a
    group. A repeated id counts once for others. Unusable vectors (null, other length, not finite, zero) have no neighbours and are no one's;
    an empty table gives no row; extra columns are ignored.
    """
    source = _select(vectors, vector_id, vector, dim)
    ids = materialise(_directions(source, dim), "directions")
    near = near_directions(source, dim, ids.count(), k + 1, min_cosine, candidates, split_over)
    # rows of one id have one rank, so that repeated rows don't displace other ids
    first = F.dense_rank().over(Window.partitionBy("h").orderBy("id"))
    heads = ids.withColumn("r", first).where(F.col("r") <= k + 1)
    members = materialise(heads.groupBy("h").agg(F.array_sort(F.collect_set("id")).alias("ids")), "members")
    others = near.join(members.select(F.col("h").alias("hb"), "ids"), "hb").select(F.col("ha").alias("h"), "cosine", F.explode("ids").alias("other"))
    own = members.where(F.size("ids") > 1).select("h", F.lit(1.0).alias("cosine"), F.explode("ids").alias("other"))
    ranked = others.unionByName(own).withColumn("r", F.row_number().over(Window.partitionBy("h").orderBy(F.desc("cosine"), "other"))).where(F.col("r") <= k + 1)
    lists = ranked.groupBy("h").agg(F.array_sort(F.collect_list(F.struct("r", "other", "cosine"))).alias("near"))
    listed = heavy_light_lookup(ids, lists, "h", "inner")
    kept = listed.select("id", F.explode(F.slice(F.filter("near", lambda x: x["other"] != F.col("id")), 1, k)).alias("x"))
    return kept.select("id", F.col("x.other").alias("other"), F.col("x.cosine").alias("cosine"))


def nearest_of_queries(
    vectors: DataFrame, vector_id: str, vector: str, is_query: str, dim: int = 64, k: int = 5, pivots: int = 256, posts: int = 4, probes: int = 24, candidates: int = 3072
) -> DataFrame:
    """(id, other, cosine): the ``k`` most similar vectors of those for which the SQL condition ``is_query`` on ``id`` holds.

    Every vector is posted under its ``posts`` nearest pivots, a query looks into the files of its ``probes``
    nearest. A file is searched in blocks of 4,096 vectors; of each block the ``candidates`` with the smallest
    footrule distance to a query, and those that tie with the last of them, are reranked by cosine. Equal cosines
    are ordered by the smaller id. Nulls, unusable vectors and copies as in ``nearest_above``, except that copies
    are found one by one.
    """
    source = _select(vectors, vector_id, vector, dim)
    chosen, _ = _pivots(source, dim, source.count(), pivots)
    length, ix = min(max(probes, PREFIX), max(1, len(chosen))), _index_type(len(chosen))
    dtype = np.dtype([("key", np.int32), ("h", np.int64), ("query", np.int8), ("perm", ix, length), ("vec", np.int16, dim)])
    flagged = source.select("id", "v", F.expr(is_query).alias("q"))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = _Blobs(max(1, len(chosen)))
        for b in batches:
            ok, u = unit_rows(b.column(1), dim)
            if not len(u):
                continue
            ids = b.column(0).filter(pa.array(ok)).to_numpy()
            asks = b.column(2).fill_null(False).filter(pa.array(ok)).to_numpy(zero_copy_only=False)
            packed, (perm, _) = quantise(u)[0], permutations(u, chosen, length)
            for p in range(length):
                for query, on in ((0, np.full(len(u), p < posts)), (1, asks & (p < probes))):
                    r = np.empty(on.sum(), dtype)
                    r["key"], r["h"], r["query"], r["perm"], r["vec"] = perm[on, p], ids[on], query, perm[on], packed[on]
                    blobs.add(r)
            if blobs.size > _FLUSH_BYTES:
                yield from blobs.flush()
        yield from blobs.flush()

    def search(t: pa.Table) -> pa.Table:
        r = np.frombuffer(b"".join(x.as_py() for x in t.column("blob")), dtype=dtype)
        out = []
        for key in np.unique(r["key"]):
            here = r[r["key"] == key]
            asks, data = here[here["query"] == 1], here[here["query"] == 0]
            if not len(asks) or not len(data):
                continue
            ua, ud = unpack(asks["vec"]), unpack(data["vec"])
            for x in range(0, len(asks), 512):
                rows = slice(x, x + 512)
                mine, hits = asks["h"][rows], []
                for y in range(0, len(data), 4096):
                    names = data["h"][y : y + 4096]
                    may = mine[:, None] != names[None, :]
                    if len(names) > candidates:
                        f = footrule(asks["perm"][rows][:, :PREFIX], data["perm"][y : y + 4096][:, :PREFIX])
                        may &= f <= np.partition(f, candidates - 1, axis=1)[:, candidates - 1][:, None]
                    c = np.where(may, ua[rows] @ ud[y : y + 4096].T, -2)
                    take = min(k, c.shape[1])
                    # all that tie with the k-th, so that ids decide among them
                    i, j = np.nonzero((c >= -np.partition(-c, take - 1, axis=1)[:, take - 1 : take]) & (c > -2))
                    top = first_k(i, names[j], c[i, j], k)
                    hits.append((i[top], names[j[top]], c[i[top], j[top]]))
                i, o, c = (np.concatenate(z) for z in zip(*hits))
                top = first_k(i, o, c, k)
                out.append((mine[i[top]], o[top], c[top]))
        q, o, c = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))
        return pa.table({"id": pa.array(q), "other": pa.array(o), "cosine": pa.array(c.astype(np.float64))})

    found = flagged.mapInArrow(post, "bucket int, blob binary").groupBy("bucket").applyInArrow(search, "id long, other long, cosine double")
    best = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "other"))
    return found.groupBy("id", "other").agg(F.max("cosine").alias("cosine")).withColumn("r", best).where(F.col("r") <= k).drop("r")
