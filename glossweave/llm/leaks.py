"""Passages of held-out texts inside a corpus, found by spaced seeds and verified by alignment.

Both sides are hashed under fixed masks that ignore some word positions, and the hashes are joined. Around
the hits an alignment counts the words of the item that the document holds in order.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossweave.operators.skew import heavy_light_lookup
from glossweave.tables import materialise, spread

#: Word positions that count; the others may hold any word.
MASKS = ("1111", "11011", "110101", "1010011")
_OFFSETS = tuple(tuple(i for i, c in enumerate(m) if c == "1") for m in MASKS)
_OFFSET_TABLE = np.array(_OFFSETS)
_WORD = re.compile(r"[^\W_]+")
_MATCH, _MISMATCH, _GAP = 1.0, -1.5, -1.2
#: Cost of a changed, left-out or added word where half of an item's words, scattered, must still carry an alignment.
_LENIENT = -0.4
_LEAST_SCORE = 4.0
#: Words in more than this share of the items belong to the phrases of the field (two items are always few).
COMMON_SHARE = 0.02
#: Seeds of more than this share of the items (two are always few) find nothing that others of the item don't.
COMMON_SEEDS = 0.01
#: An item with fewer rare words than this share of its words has those rare that are no more frequent than its median word.
_FEW_RARE = 0.2
#: Of an item's rare words at least this part of the required share must be among the words found.
_RARE_SHARE = 0.6
#: Of the words that a leak needs, at least this part must be covered by shared seeds in one order, and of the rare words
#: at least this part by shared seeds; scattered left-out words break most seeds.
_CHAINED, _SEEDED = 0.24, 0.2
#: Up to so many documents with candidates are looked up in the corpus by a broadcast of their keys, more by a shuffle.
BROADCAST_DOCS = 200_000
#: Bits of a sieve of hashes that is broadcast, at most; beyond it more seeds reach the join than need to.
SIEVE_BITS = 27
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], np.uint64)
_CACHE_WORDS = 500_000


def words(text: str) -> list[str]:
    """Lower-case runs of letters and digits, in compatibility form."""
    return _WORD.findall(unicodedata.normalize("NFKC", text).lower())


def word_codes(text: str, cache: dict[str, int]) -> np.ndarray:
    """A 64-bit hash of every word; ``cache`` keeps those of frequent words."""
    if len(cache) > _CACHE_WORDS:
        cache.clear()
    out = []
    for w in words(text):
        c = cache.get(w)
        if c is None:
            c = cache[w] = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        out.append(c)
    return np.array(out, np.uint64)


def seeds(codes: np.ndarray, may: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, position, mask) of every place where all words of a mask have ``may``."""
    hs, ats, masks = [], [], []
    for m, offsets in enumerate(_OFFSETS):
        n = len(codes) - offsets[-1]
        if n <= 0:
            continue
        on = may[:n].copy()
        for o in offsets[1:]:
            on &= may[o : o + n]
        at = np.nonzero(on)[0]
        h = np.full(len(at), (m + 1) * 0xD1B54A32D192ED03 % 2**64, np.uint64)
        for j, o in enumerate(offsets):
            x = codes[at + o] * _FACTORS[j]
            h += x ^ (x >> np.uint64(31))
        h *= _FACTORS[1]
        hs.append(h ^ (h >> np.uint64(29)))
        ats.append(at)
        masks.append(np.full(len(at), m))
    if not hs:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hs), np.concatenate(ats), np.concatenate(masks)


def rare_words(used: np.ndarray, n_items: int) -> np.ndarray:
    """Which words of an item are rare, from the number of items that use each."""
    rare = used <= max(2, int(n_items * COMMON_SHARE))
    return rare if rare.sum() >= _FEW_RARE * len(used) else used <= np.median(used)


def align(item: np.ndarray, text: np.ndarray, mismatch: float = _MISMATCH, gap: float = _GAP) -> tuple[float, list[int], int, int, int, int]:
    """Best local alignment: score, matched item positions, and the half-open ranges in item and text."""
    n, m = len(item), len(text)
    if not n or not m:
        return 0.0, [], 0, 0, 0, 0
    # rows are kept with the text gaps' cost added back, which makes the best gap a running maximum
    ramp = np.arange(m + 1, dtype=np.float32) * np.float32(-gap)
    sub = np.where(item[:, None] == text[None, :], np.float32(_MATCH - gap), np.float32(mismatch - gap))
    s = np.empty((n + 1, m + 1), np.float32)
    s[0] = ramp
    t = np.empty(m, np.float32)
    for i in range(n):
        row = s[i + 1]
        row[0] = 0
        np.add(s[i, :-1], sub[i], out=row[1:])
        np.add(s[i, 1:], np.float32(gap), out=t)
        np.maximum(row[1:], t, out=row[1:])
        np.maximum(row, ramp, out=row)
        np.maximum.accumulate(row, out=row)
    s -= ramp
    i, j = np.unravel_index(int(s.argmax()), s.shape)
    best, i1, j1, matched = float(s[i, j]), int(i), int(j), []
    while i > 0 and j > 0 and s[i, j] > 1e-3:
        eq = text[j - 1] == item[i - 1]
        if abs(s[i - 1, j - 1] + (_MATCH if eq else mismatch) - s[i, j]) < 1e-2:
            i, j = i - 1, j - 1
            if eq:
                matched.append(int(i))
        elif abs(s[i - 1, j] + gap - s[i, j]) < 1e-2:
            i -= 1
        else:
            j -= 1
    return best, matched, int(i), i1, int(j), j1


def overlap(item: np.ndarray, text: np.ndarray, reach: int, need: float, mismatch: float = _MISMATCH, gap: float = _GAP) -> tuple[list[int], int, int]:
    """Item positions found in order in one or two passages at most ``reach`` words apart; the text range.

    Nothing when the larger passage has less than half of the ``need`` words, as two can't make them up then.
    """
    score, matched, i0, i1, j0, j1 = align(item, text, mismatch, gap)
    if score < _LEAST_SCORE or 2 * len(matched) < need:
        return [], 0, 0
    best = (matched, j0, j1)
    lo = max(0, j0 - reach - 2 * i0)
    sides = (("before", item[:i0], text[lo:j0], lo, 0), ("after", item[i1:], text[j1 : j1 + reach + 2 * (len(item) - i1)], j1, i1))
    for side, x, y, at, shift in sides:
        if len(x) < _LEAST_SCORE or len(y) < _LEAST_SCORE:
            continue
        s2, m2, _, _, a, b = align(x, y, mismatch, gap)
        near = (j0 - (at + b)) if side == "before" else a
        if s2 >= _LEAST_SCORE and near <= reach and len(matched) + len(m2) > len(best[0]):
            best = (matched + [p + shift for p in m2], min(j0, at + a), max(j1, at + b))
    return best


def in_order(item: np.ndarray, text: np.ndarray) -> int:
    """Length of the longest common subsequence, by bit-parallel counting: no alignment matches more words."""
    at: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        at[w] = at.get(w, 0) | (1 << i)
    full = (1 << len(item)) - 1
    v = full
    for w in text.tolist():
        m = at.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(item) - v.bit_count()


_STRICT, _SCATTERED = (_MISMATCH, _GAP), (_LENIENT, _LENIENT)
_MARK = 1e-6


def best_passages(items: list[np.ndarray], texts: list[np.ndarray], mismatch: float, gap: float) -> np.ndarray:
    """Words matched by the best local alignment of each item with its text, many pairs at a time.

    Scores are multiples of a tenth; each match adds a mark too small to change their order, and the marks of the
    best score are the matches (the most there are among equal scores).
    """
    out = np.zeros(len(items), np.int64)
    order = np.argsort([len(x) for x in items], kind="stable")
    for at in range(0, len(order), 64):
        some = order[at : at + 64]
        n, m = max(len(items[k]) for k in some), max(len(texts[k]) for k in some)
        x, y = np.zeros((len(some), n), np.uint64), np.ones((len(some), m), np.uint64)
        real = np.zeros((len(some), n), bool)
        for r, k in enumerate(some):
            x[r, : len(items[k])], y[r, : len(texts[k])], real[r, : len(items[k])] = items[k], texts[k], True
        there = np.arange(m)[None, :] < np.array([len(texts[k]) for k in some])[:, None]
        ramp = np.arange(m + 1) * -gap
        row, best = np.tile(ramp, (len(some), 1)), np.zeros(len(some))
        for i in range(n):
            same = (y == x[:, i : i + 1]) & there & real[:, i : i + 1]
            new = np.empty_like(row)
            new[:, 0] = 0
            np.add(row[:, :-1], np.where(same, _MATCH + _MARK - gap, mismatch - gap), out=new[:, 1:])
            np.maximum(new[:, 1:], row[:, 1:] + gap, out=new[:, 1:])
            np.maximum(new, ramp, out=new)
            np.maximum.accumulate(new, axis=1, out=new)
            row = new
            np.maximum(best, (row - ramp).max(axis=1), out=best)
        out[some] = np.rint((best - np.rint(best * 10) / 10) / _MARK).astype(np.int64)
    return out


@dataclass
class Candidate:
    """An item, a text that may hold it, and their shared seeds."""

    item: np.ndarray
    rare: np.ndarray
    own: np.ndarray
    text: np.ndarray
    pos: np.ndarray
    at: np.ndarray
    mask: np.ndarray

    def windows(self, least_share: float, reach: int) -> list[tuple[int, np.ndarray]]:
        """(first word, words) of the places where enough of the item, and of its rare words, is there in order; most seeded first."""
        item, need, least_rare = self.item, least_share * len(self.item), _RARE_SHARE * least_share * self.rare.sum()
        names = np.sort(item)
        met = np.nonzero(names[np.minimum(np.searchsorted(names, self.text), len(names) - 1)] == self.text)[0]
        shared = self.text[met]
        # no window holds more of the item's words, or more of them in order, than the whole text does
        if len(shared) < need or in_order(item, shared) < need:
            return []
        step = (2 * len(item) + reach) // 2  # two steps are as wide as a pair of passages may be
        slot, out = self.at // step, []
        for s in np.unique(np.concatenate([slot, slot - 1])):
            inside = (slot == s) | (slot == s + 1)
            covered = np.zeros(len(item), bool)
            covered[(self.pos[inside, None] + _OFFSET_TABLE[self.mask[inside]]).ravel()] = True
            if (covered & self.rare).sum() < _SEEDED * least_rare:
                continue
            lo = max(0, int(s) * step - 8)
            here = shared[slice(*np.searchsorted(met, (lo, (int(s) + 2) * step + 8)))]
            if len(here) >= need and in_order(item, here) >= need and in_order(item[self.rare], here) >= least_rare:
                out.append((-int(covered.sum()), lo, self.text[lo : (int(s) + 2) * step + 8]))
        return [(lo, w) for _, lo, w in sorted(out, key=lambda x: x[:2])]


def leaks(candidates: list[Candidate], least_share: float, reach: int) -> list[tuple[int, int, int] | None]:
    """(matched words, first word, end word) of every candidate whose text holds at least ``least_share`` of its item, else None.

    All windows are aligned at strict costs; where that finds too few words, again at costs that scattered changes
    bear, if words of no other item are there too: sentences of one pattern with other names and numbers are no
    leak. Windows whose best passage has less than half of the words needed are told from ``best_passages``, in
    batches; only the others are followed word by word.
    """
    out: list[tuple[int, int, int] | None] = [None] * len(candidates)
    todo = [(k, lo, w) for k, c in enumerate(candidates) for lo, w in c.windows(least_share, reach)]
    need = [least_share * len(c.item) for c in candidates]
    for costs in (_STRICT, _SCATTERED):
        todo = [t for t in todo if out[t[0]] is None]
        if costs is _SCATTERED:
            todo = [t for t in todo if in_order(candidates[t[0]].item[candidates[t[0]].own], t[2]) >= _least_own(candidates[t[0]], least_share)]
        passage = best_passages([candidates[k].item for k, _, _ in todo], [w for _, _, w in todo], *costs)
        for (k, lo, window), found in zip(todo, passage):
            c = candidates[k]
            if out[k] is not None or 2 * found < need[k]:
                continue
            m, j0, j1 = overlap(c.item, window, reach, need[k], *costs)
            enough = len(m) >= need[k] and c.rare[m].sum() >= _RARE_SHARE * least_share * c.rare.sum()
            if enough and (costs is _STRICT or c.own[m].sum() >= _least_own(c, least_share)):
                out[k] = (len(m), lo + j0, lo + j1)
    return out


def _least_own(c: Candidate, least_share: float) -> float:
    return _RARE_SHARE * least_share * c.own.sum()


def _sieve(df: DataFrame, column: str, n: int) -> np.ndarray:
    """Which leading bits the hashes of ``column`` have: a table of 32 places for each of ``n``, of ``SIEVE_BITS`` bits at most."""
    bits = min(SIEVE_BITS, max(16, math.ceil(math.log2(32 * max(1, n)))))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        on = np.zeros(1 << bits, bool)
        for b in batches:
            on[b.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - bits)] = True
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % 4], pa.int32()), pa.array([np.packbits(on).tobytes()], pa.binary())], ["k", "x"])

    def add(t: pa.Table) -> pa.Table:
        x = np.bitwise_or.reduce([np.frombuffer(v.as_py(), np.uint8) for v in t.column("x")])
        return pa.table({"x": pa.array([x.tobytes()], pa.binary())})

    rows = df.select(column).mapInArrow(mark, "k int, x binary").groupBy("k").applyInArrow(add, "x binary").collect()
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in rows:
        out |= np.frombuffer(bytes(r["x"]), np.uint8)
    return out


def _through(sieve: np.ndarray, h: np.ndarray) -> np.ndarray:
    shift = np.uint64(64 - (len(sieve) * 8).bit_length() + 1)
    top = h >> shift
    return (sieve[top >> np.uint64(3)] >> (np.uint64(7) - (top & np.uint64(7))).astype(np.uint8)) & 1 == 1


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64), pa.int64())


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _longs(np.concatenate(parts) if parts else np.zeros(0, np.int64)))


def _held_out(held: DataFrame) -> DataFrame:
    """(i, item, codes, used, n_items): the words of every item, and how many items use each of them."""
    kind = held.schema["item"].dataType.simpleString()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), _lists([word_codes(t.as_py(), cache) for t in b.column(1)])], ["item", "codes"])

    coded = held.mapInArrow(code, f"item {kind}, codes array<bigint>").where(F.size("codes") > 0)
    items = materialise(coded.withColumn("i", F.monotonically_increasing_id()), "items")
    n_items = items.count()
    used = items.select(F.explode(F.array_distinct("codes")).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("used"))
    placed = heavy_light_lookup(items.select("i", F.posexplode("codes").alias("pos", "c")), used, "c", "inner")
    flags = placed.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("pos", "used"))).alias("u"))
    return materialise(items.join(flags, "i").select("i", "item", "codes", F.col("u.used").alias("used"), F.lit(n_items).cast("long").alias("n_items")), "items")


def _item_seeds(items: DataFrame, least_share: float) -> DataFrame:
    """(h, i, pos, mask, least): the seeds of all items that tell something, and how many words of the item a chain of them must cover.

    Those are seeds that hold a rare word and that few items share; for an item which others copy, so that few
    items share hardly any of its seeds, all seeds that hold a rare word.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, codes, used, n in zip(*(b.column(k).to_pylist() for k in range(4))):
                x = np.array(codes, np.int64).view(np.uint64)
                h, at, mask = seeds(x, np.ones(len(x), bool))
                on = rare_words(np.array(used), n)[at[:, None] + _OFFSET_TABLE[mask]].any(axis=1) if len(h) else np.zeros(0, bool)
                same = lambda v, m=int(on.sum()): np.full(m, v, np.int64)
                out.append((h[on], same(i), at[on], mask[on], same(len(x)), same(len(h)), same(max(2, int(n * COMMON_SEEDS)))))
            h, *rest = (np.concatenate(z) for z in zip(*out)) if out else (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 6
            yield pa.RecordBatch.from_arrays([_longs(z) for z in (h, *rest)], ["h", "i", "pos", "mask", "n", "n_seeds", "few"])

    made = materialise(items.select("i", "codes", "used", "n_items").mapInArrow(cut, "h long, i long, pos long, mask long, n long, n_seeds long, few long"), "seeds")
    shared = heavy_light_lookup(made, made.groupBy("h").agg(F.count_distinct("i").alias("by")), "h", "inner").withColumn("own", F.col("by") <= F.col("few"))
    # seeds of one item come from one text, so this window holds no more than that
    per = shared.groupBy("i").agg(F.count_if("own").alias("k"), F.count(F.lit(1)).alias("m"))
    kept = shared.join(per, "i").withColumn("kept", F.when(F.col("k") >= _FEW_RARE * F.col("m"), F.col("k")).otherwise(F.col("m"))).where("own OR kept = m")
    # the fewer of its seeds are used, the less of an item they can cover
    return kept.select("h", "i", "pos", "mask", F.ceil(_CHAINED * least_share * F.col("n") * F.col("kept") / F.col("n_seeds")).alias("least"))


def chained(pos: np.ndarray, at: np.ndarray, mask: np.ndarray) -> int:
    """Item words covered by a longest chain of shared seeds that follow each other in the item and in the text."""
    tails: list[int] = []
    ends: list[int] = []
    before: list[int] = [-1] * len(pos)
    ps = pos.tolist()
    for k in np.lexsort((-pos, at)).tolist():
        j = bisect_left(tails, ps[k])
        if j == len(tails):
            tails.append(ps[k])
            ends.append(k)
        else:
            tails[j], ends[j] = ps[k], k
        before[k] = ends[j - 1] if j else -1
    k, cover = (ends[-1] if ends else -1), set()
    while k >= 0:
        cover.update(ps[k] + o for o in _OFFSETS[mask[k]])
        k = before[k]
    return len(cover)


def find_leaks(corpus: DataFrame, doc_id: str, text: str, held_out: DataFrame, item_id: str, item_text: str, least_share: float = 0.5, reach: int = 80) -> DataFrame:
    """(item_id, doc_id, matched_words, n_words, first_word, end_word): the held-out items each document leaks.

    Spaced seeds (``MASKS``) of the held-out texts that hold a rare word, and that few items share, are joined
    with those of the corpus; where a chain of hits covers enough of an item, an alignment that allows substituted, left-out and added words
    counts the item's words found in its order, in one passage or in two at most ``reach`` words apart. A document leaks an item when
    these are at least ``least_share`` of its words, and rare words of the item are among them, so that
    phrases which many items share are not enough. Rare is counted over all items. Case, punctuation, markup
    signs and white space don't matter.

    Seeds that no item can have are left out before the join by a sieve of the items' hashes, whose size is
    bounded (``SIEVE_BITS``); only hits are shuffled, and only documents with a candidate are read again. Whole texts are searched. Null, empty and blank texts and items leak nothing; repeated documents
    and items are reported each on their own; extra columns are ignored.
    """
    doc_type, item_type = corpus.schema[doc_id].dataType.simpleString(), held_out.schema[item_id].dataType.simpleString()
    schema = f"item {item_type}, doc {doc_type}, matched_words long, n_words long, first_word long, end_word long"
    held = held_out.select(F.col(item_id).alias("item"), F.col(item_text).alias("text")).where("item IS NOT NULL AND length(text) > 0")
    items = _held_out(held)
    marks = materialise(_item_seeds(items, least_share), "seeds")
    vocabulary = items.select(F.explode("codes").alias("c"))
    shared = corpus.sparkSession.sparkContext.broadcast((_sieve(vocabulary, "c", vocabulary.count()), _sieve(marks, "h", marks.count())))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seeded = shared.value
        cache: dict[str, int] = {}
        for b in batches:
            on, hs, ats = [], [], []
            for k, t in enumerate(b.column(2)):
                x = word_codes(t.as_py(), cache)
                h, at, _ = seeds(x, _through(known, x))
                hit = _through(seeded, h)
                if hit.any():
                    on.append(k)
                    hs.append(h[hit])
                    ats.append(at[hit])
            there = pa.array(on, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(there), b.column(1).take(there), _lists(hs), _lists(ats)], ["doc", "t", "h", "at"])

    def in_chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists, least = [b.column(k) for k in (3, 4, 5)], b.column(6).to_pylist()
            yield b.filter(pa.array([chained(*(c[k].values.to_numpy() for c in lists)) >= least[k] for k in range(b.num_rows)], pa.bool_()))

    # a document is told by its id and its text, so that rows which share an id are told apart and copies meet again below
    docs = corpus.select(F.col(doc_id).alias("doc"), F.xxhash64(text).alias("t"), F.col(text).alias("text")).where("doc IS NOT NULL AND length(text) > 0")
    seen = spread(docs, "doc").mapInArrow(look, f"doc {doc_type}, t long, h array<bigint>, at array<bigint>")
    hits = materialise(seen.select("doc", "t", F.inline(F.arrays_zip("h", "at"))), "hits")
    lookup = marks.groupBy("h").agg(F.collect_list(F.struct("i", "pos", "mask", "least")).alias("of"))
    met = heavy_light_lookup(hits, lookup, "h", "inner").select("doc", "t", "at", F.inline("of"))
    pairs = met.groupBy("doc", "t", "i").agg(F.collect_set(F.struct("pos", "at", "mask")).alias("m"), F.max("least").alias("least"))
    # a seed covers four words
    pairs = pairs.where(F.size("m") * 4 >= F.col("least")).select("doc", "t", "i", F.col("m.pos").alias("pos"), F.col("m.at").alias("at"), F.col("m.mask").alias("mask"), "least")
    pairs = materialise(pairs.mapInArrow(in_chain, pairs.schema), "pairs")
    named = heavy_light_lookup(pairs, items.withColumnRenamed("codes", "words"), "i", "inner")
    # documents with a candidate, by a broadcast of their keys where these are few
    keys = pairs.select("doc", "t").distinct()
    again = docs.join(F.broadcast(keys) if keys.count() <= BROADCAST_DOCS else keys, ["doc", "t"], "left_semi")
    full = again.join(named, ["doc", "t"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        for b in batches:
            some, last, y = [], None, np.zeros(0, np.uint64)
            text_, lists = b.column(2), [b.column(k) for k in range(3, 8)]
            for k in range(b.num_rows):
                x, used, pos, at, mask = (c[k].values.to_numpy() for c in lists)
                if last is None or text_[k] != text_[last]:
                    last, y = k, word_codes(text_[k].as_py(), cache)
                some.append(Candidate(x.view(np.uint64), rare_words(used, b.column(8)[k].as_py()), used == 1, y, pos, at, mask))
            found = leaks(some, least_share, reach)
            on = pa.array([k for k, f in enumerate(found) if f], pa.int64())
            rows = [(f[0], len(c.item), *f[1:]) for c, f in zip(some, found) if f]
            cols = [pa.array(z, pa.int64()) for z in zip(*rows)] if rows else [pa.array([], pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([b.column(0).take(on), b.column(1).take(on), *cols], ["item", "doc", "matched_words", "n_words", "first_word", "end_word"])

    ready = full.select("item", "doc", "text", "words", "used", "pos", "at", "mask", "n_items")
    return ready.mapInArrow(verify, schema).withColumnsRenamed({"item": item_id, "doc": doc_id})
