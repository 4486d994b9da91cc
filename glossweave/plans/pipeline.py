"""Drivers: fitting a linker, linking texts, selecting a model, resumable runs."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave.functions.text import tokens_of
from glossweave.functions.vectors import mean_vectors, unit_rows
from glossweave.operators import composition as comp
from glossweave.operators import linking as lk
from glossweave.operators.frames import drop_rare, top_by_draw
from glossweave.operators.grid import solve_sizes
from glossweave.operators.learning import LinearScreener, cluster_sample, fit_lda, size_grid
from glossweave.operators.metrics import z_scores
from glossweave.operators.vectors import HashingEncoder, PcaModel, reduce_dimensions
from glossweave.sources.readers import load_json
from glossweave.sources.writers import write_json
from glossweave.tables import drop_materialised, materialise, spread

METRICS = ["pca_residual", "pca_mahalanobis", "pca_spectral_entropy"]


@dataclass(frozen=True)
class LinkerConfig:
    """Settings of a fit, checked (Q23)."""

    dim: int = 64
    pca: int = 24
    reduced: int = 8
    sizes: tuple[int, ...] = (15, 25, 40)
    sample_rows: int = 1500
    min_mentions: int = 5
    threshold: float = 0.5
    negative: str = "negative"
    seed: int = 13

    def __post_init__(self):
        if not 0 <= self.threshold <= 1 or self.dim < 1 or self.pca < 1 or self.reduced < 1 or self.sample_rows < 2 or not self.sizes or min(self.sizes) < 2:
            raise ValueError(f"bad settings: {self}")


@dataclass
class Linker:
    """A fitted linker: projection, screener, cluster heads and their entities (Q10, Q33)."""

    config: LinkerConfig
    pca: PcaModel
    screener: LinearScreener
    assignments: DataFrame
    heads: DataFrame
    chosen_size: int

    @staticmethod
    def fit(mentions: DataFrame, kb: DataFrame, config: LinkerConfig) -> Linker:
        """From a mention frame (row_id, entity, mention, embed) and a knowledge base (entity_id, entity) (Q3, Q10).

        Projection and screener see all rows; density clustering sees ``sample_rows`` of them, the rest is
        labelled by the nearest cluster head. Entities get their clusters from the labels of all rows.
        """
        named = mentions.where("entity IS NOT NULL").select("row_id", "entity", "embed")
        rows = materialise(drop_rare(named, config.min_mentions, config.negative), "named")
        known = rows.where(F.col("entity") != config.negative)
        pca = PcaModel.fit(known, "embed", config.dim, config.pca)
        screener = fit_lda(rows.withColumn("y", (F.col("entity") == config.negative).cast("int")), "embed", "y", config.dim)
        sample = materialise(reduce_dimensions(top_by_draw(known, config.sample_rows, config.seed), "embed", config.dim, config.reduced), "sample")
        grid = size_grid(sample, "row_id", "u", "entity", list(config.sizes))
        agg = grid.select(
            "min_cluster_size", F.when(~F.isnan("dbcv"), F.col("dbcv")).alias("dbcv_mean"), F.lit(0.0).alias("dbcv_std"), F.lit(1).alias("dbcv_count"),
            F.col("ari").alias("ari_mean"), F.lit(0.0).alias("ari_std"), F.lit(1).alias("ari_count"), F.col("n_clusters").alias("n_clusters_mean"),
        )
        solved = solve_sizes(agg, []).first()
        size = int(solved["chosen"]) if solved and solved["chosen"] else min(config.sizes)
        fitted = materialise(cluster_sample(sample, "row_id", "u", size), "fitted")
        clustered = fitted.where("cluster >= 0").join(sample.select("row_id", "embed"), "row_id")
        heads = materialise(mean_vectors(clustered, ["cluster"], "embed"), "heads")
        near = to_heads(known, heads.select(F.col("cluster").cast("long").alias("id"), "embed"), config.dim)
        labelled = lk.override_labels(near, fitted, "row_id")
        assigned = materialise(comp.provisional_assignments(kb.select("entity_id", "entity"), labelled).withColumn("ord", F.col("entity_id")), "assigned")
        drop_materialised(rows)
        return Linker(config, pca, screener, assigned, heads, size)

    def score(self, mentions: DataFrame, batch: list[str] | None = None) -> DataFrame:
        """Mentions with metrics, their largest z-score, screener value, cluster and similarity."""
        scored = self.screener.score(self.pca.transform(mentions, "embed").drop("p"), "embed", "projection_score")
        scored = z_scores(scored.withColumn("__batch", F.lit(0)), METRICS, batch or ["__batch"]).drop("__batch")
        heads = self.heads.select(F.col("cluster").cast("long").alias("id"), "embed")
        return to_heads(scored, heads, self.config.dim)

    def predict(self, mentions: DataFrame) -> DataFrame:
        """Linked mentions without their vectors: gates, overlap resolution, then the threshold (Q11, Q16, traps X24, X25)."""
        # nothing after the scores needs a vector, so none goes through the shuffle of the overlaps
        gated = lk.gate(self.score(mentions).drop("embed"), self.assignments, 0.0, F.col("projection_score") > 0)
        best = lk.overlap_islands(gated, "itext", "score", "row_id")
        return best.where(F.col("score") >= self.config.threshold)

    def save(self, folder: str) -> None:
        """Parquet and JSON, never pickle."""
        self.assignments.write.mode("overwrite").parquet(f"{folder}/assignments")
        self.heads.write.mode("overwrite").parquet(f"{folder}/heads")
        state = {
            "config": asdict(self.config), "chosen_size": self.chosen_size, "pca": [self.pca.mean.tolist(), self.pca.components.tolist(), self.pca.variances.tolist()],
            "screener": [self.screener.weights.tolist(), self.screener.bias, self.screener.kind],
        }
        write_json(state, f"{folder}/linker.json", "glossweave.linker.v1")

    @staticmethod
    def load(spark: SparkSession, folder: str) -> Linker:
        """What ``save`` wrote; settings it did not have get their defaults."""
        s = load_json(f"{folder}/linker.json")
        config = LinkerConfig(**{k: tuple(v) if isinstance(v, list) else v for k, v in s["config"].items()})
        w, b, kind = s["screener"]
        return Linker(config, PcaModel(*map(np.array, s["pca"])), LinearScreener(np.array(w), b, kind), spark.read.parquet(f"{folder}/assignments"), spark.read.parquet(f"{folder}/heads"), s["chosen_size"])


def _nearest_head(heads: DataFrame, dim: int) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """Cluster and cosine of the nearest head of each vector; heads are at most sample_rows / smallest size, so they are collected."""
    rows = sorted((r["id"], r["embed"]) for r in heads.collect())
    ids = np.array([r[0] for r in rows], dtype=np.int64)
    u = unit_rows(pa.array([r[1] for r in rows], pa.list_(pa.float64())), dim)[1] if rows else np.zeros((0, dim))

    def nearest(v: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ok, x = unit_rows(v, dim)
        cluster, score = np.full(len(v), -1), np.zeros(len(v))
        if len(u) and len(x):
            c = x @ u.T
            cluster[ok], score[ok] = ids[c.argmax(axis=1)], c.max(axis=1)
        return cluster, score

    return nearest


def to_heads(df: DataFrame, heads: DataFrame, dim: int) -> DataFrame:
    """``cluster`` and ``score`` (cosine) of the nearest head."""
    find = _nearest_head(heads, dim)

    def nearest(v: pa.Array) -> pa.Array:
        cluster, score = find(v)
        return pa.StructArray.from_arrays([pa.array(cluster, pa.int32()), pa.array(score)], ["cluster", "score"])

    return df.where(F.size("embed") == dim).withColumn("__n", F.arrow_udf(nearest, "struct<cluster:int,score:double>")("embed")).select("*", "__n.cluster", "__n.score").drop("__n")


#: Characters of texts whose windows are held at a time; a longer text is held alone.
_TEXT_BLOCK = 500_000
#: Words whose vectors a task keeps, and lemmas scored at a time.
_WORDS_KEPT, _LEMMA_BLOCK = 100_000, 50_000


def link_texts(linker: Linker, docs: DataFrame, encoder: HashingEncoder) -> DataFrame:
    """Entities in texts (itext, text): windows, encoding, prediction, public columns.

    Every window of every text is looked at, where its text is: windows are cut, encoded by their lemmas and gated in
    one pass, in which each group of overlapping mentions of a text becomes its best ones (several only if score,
    length and mention are equal) with the extent of the group. Only these are shuffled, so that texts of the same
    id meet; groups of several texts that overlap are one.
    """
    entity = {r["cluster"]: r["entity_id"] for r in lk.cluster_entities(linker.assignments).collect()}  # no more than heads
    mapped = np.array(sorted(c for c in entity if c is not None and c != -1), dtype=np.int64)
    find = _nearest_head(linker.heads.select(F.col("cluster").cast("long").alias("id"), "embed"), linker.config.dim)
    screener = linker.screener

    def judge(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which vectors pass the gates, their clusters and cosines."""
        cluster, score = find(pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel())))
        return np.isin(cluster, mapped) & (score >= 0) & ~(screener.values(x) > 0), cluster, score

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, np.ndarray] = {}
        for b in batches:
            size = np.cumsum(pc.utf8_length(b.column(1)).fill_null(0).to_numpy(zero_copy_only=False))
            at = 0
            while at < b.num_rows:
                end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + _TEXT_BLOCK, side="right")))
                out = _best_windows(b.slice(at, end - at), encoder, known, judge, entity)
                if out.num_rows:
                    yield out
                at = end

    kind = docs.schema["itext"].dataType.simpleString()
    to = f"doc {kind}, wg int, a int, b int, lo int, hi int, mention string, entity_id string, score double"
    place = {c: F.col(x).cast("long") for c, x in (("a", "a"), ("b", "b"), ("a_abs", "a"), ("b_abs", "b"))}

    def found(some: DataFrame) -> DataFrame:
        out = some.mapInArrow(run, to).select(F.xxhash64("doc", "wg", "a", "b").alias("row_id"), F.col("doc").alias("itext"), "mention", *[v.alias(c) for c, v in place.items()], "lo", "hi", "entity_id", "score")
        return lk.interval(out)

    # told apart before the pass, so that no text goes through it twice; mentions without a text's id overlap none
    named, unnamed = (docs.select("itext", "text").where(c) for c in ("itext IS NOT NULL", "itext IS NULL"))
    best = lk.best_of_islands(found(spread(named, "itext")), "itext", "score", "row_id", ("lo", "hi")).unionByName(found(unnamed))
    return lk.public_view(best.where(F.col("score") >= linker.config.threshold))


def _best_windows(texts: pa.RecordBatch, encoder: HashingEncoder, known: dict[str, np.ndarray], judge: Callable, entity: dict) -> pa.RecordBatch:
    """The best passing windows of each group of overlapping ones of each text (itext, text), with the group's extent."""
    if len(known) > _WORDS_KEPT:
        known.clear()
    lists = tokens_of(texts.column(1))
    toks = lists.flatten()
    a, b = (toks.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("ix", "ix_end"))
    word = np.array(pc.equal(toks.field("pos"), "WORD").to_pylist(), dtype=bool)
    stop = np.array(toks.field("is_stop").to_pylist(), dtype=bool)
    of = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    lemmas = toks.field("lemma").dictionary_encode()
    names, ix = lemmas.dictionary.to_pylist(), lemmas.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    # windows: width, first token, and the places of its words among the names, -1 behind the last
    wg, first, parts = [], [], []
    for w in lk.WIDTHS:
        i = np.arange(max(0, len(ix) - w + 1))
        run = i[:, None] + np.arange(w)
        i = i[(of[i] == of[i + w - 1]) & word[run].all(axis=1) & ~stop[run].all(axis=1)]
        wg.append(np.full(len(i), w))
        first.append(i)
        parts.append(np.hstack([ix[i[:, None] + np.arange(w)], np.full((len(i), max(lk.WIDTHS) - w), -1)]))
    wg, first, parts = np.concatenate(wg), np.concatenate(first), np.concatenate(parts)
    # each distinct lemma once: it keeps the row of ``parts`` where it is first
    order = np.lexsort(parts.T)
    new = np.ones(len(order), bool)
    new[1:] = (parts[order[1:]] != parts[order[:-1]]).any(axis=1)
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    some = parts[order[new]]
    passes, cluster, score = np.zeros(len(some), bool), np.full(len(some), -1), np.zeros(len(some))
    vector = np.zeros((len(names) + 1, encoder.dim))  # the last one, of no word, stays zero
    for k in np.unique(some[some >= 0]):
        if names[k] not in known:
            known[names[k]] = encoder.word(names[k])
        vector[k] = known[names[k]]
    for i in range(0, len(some), _LEMMA_BLOCK):
        p = some[i : i + _LEMMA_BLOCK]
        x = vector[p[:, 0]]
        for j in range(1, p.shape[1]):
            x = x + vector[p[:, j]]
        at = slice(i, i + len(p))
        passes[at], cluster[at], score[at] = judge(x / (p >= 0).sum(axis=1)[:, None])
    on = np.nonzero(passes[which])[0]
    wg, which, t, x, y = wg[on], which[on], of[first[on]], a[first[on]], b[first[on] + wg[on] - 1]
    order = np.lexsort((y, x, t))
    wg, which, t, x, y = wg[order], which[order], t[order], x[order], y[order]
    keep, lo, hi = lk.text_islands(t, x, y, score[which], texts.column(0).is_null().to_numpy(zero_copy_only=False), lambda r: texts.column(1)[int(t[r])].as_py()[x[r] : y[r]])
    wg, which, t, x, y = wg[keep], which[keep], t[keep], x[keep], y[keep]
    bodies = {int(k): texts.column(1)[int(k)].as_py() for k in np.unique(t)}
    cols = [texts.column(0).take(pa.array(t)), *[pa.array(c, pa.int32()) for c in (wg, x, y, lo, hi)], pa.array([bodies[int(k)][p:q] for k, p, q in zip(t, x, y)], pa.string()),
            pa.array([entity[int(c)] for c in cluster[which]], pa.string()), pa.array(score[which], pa.float64())]
    return pa.RecordBatch.from_arrays(cols, ["doc", "wg", "a", "b", "lo", "hi", "mention", "entity_id", "score"])


def fingerprint(config: dict) -> str:
    """sha256 of the sorted settings (Q20)."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def key_of(members: list[tuple[str, str]]) -> str:
    """arity:model/layer+model/layer, sorted."""
    if not members:
        raise ValueError("no members")
    return f"{len(members)}:" + "+".join(f"{m}/{x}" for m, x in sorted(members))


def members_of(key: str) -> list[tuple[str, str]]:
    """The inverse of ``key_of``."""
    return [tuple(x.rsplit("/", 1)) for x in key.split(":", 1)[1].split("+")]


@dataclass
class RunState:
    """A resumable run: settings' fingerprint, finished keys with their summaries, failures (Q20, Q21)."""

    run_fingerprint: str
    summaries: dict[str, dict] = field(default_factory=dict)
    scores: dict[str, float] = field(default_factory=dict)
    failures: list[dict] = field(default_factory=list)

    @property
    def done(self) -> set[str]:
        """Keys that need not be run again."""
        return set(self.summaries)

    def finish(self, key: str, summary: dict, score: float | None = None) -> None:
        """Record a result; single members also keep their score."""
        self.summaries[key] = summary
        if score is not None and key.startswith("1:"):
            self.scores[key] = score

    def fail(self, key: str, error: Exception) -> None:
        """Record a failure with its time."""
        at = datetime.now(timezone.utc).replace(microsecond=0).isoformat()
        self.failures.append({"key": key, "error": str(error)[:500], "at": at})

    def score(self, key: str) -> float | None:
        """The stored score, else the summary's (Q21)."""
        return self.scores.get(key, self.summaries.get(key, {}).get("score"))

    def drop_fusions(self) -> int:
        """Forget combinations of several members; how many there were."""
        gone = [k for k in self.summaries if int(k.split(":", 1)[0]) >= 2]
        for k in gone:
            del self.summaries[k]
        return len(gone)

    def save(self, path: str) -> None:
        """Atomically, as JSON."""
        write_json(asdict(self) | {"version": 1}, path)

    @staticmethod
    def load(path: str, config: dict) -> RunState:
        """A stored state, refused when its settings differ; a new one where there is none."""
        mark = fingerprint(config)
        if not os.path.exists(path):
            return RunState(mark)
        data = load_json(path)
        if data["run_fingerprint"] != mark:
            raise ValueError("the run was started with other settings")
        return RunState(mark, data["summaries"], data["scores"], data["failures"])


def select_model(frames: dict[tuple[str, str], DataFrame], config: LinkerConfig, n_samples: int, state: RunState | None = None, path: str | None = None) -> DataFrame:
    """(model, layer, sample_idx, min_cluster_size, icm, n_clusters, dbcv, ari): grids of bootstrapped samples (Q3, Q4, Q6).

    Combinations that ``state`` has are not run again; after each the state is saved.
    """
    spark = next(iter(frames.values())).sparkSession
    state = state or RunState(fingerprint(asdict(config)))
    for (model, layer), df in sorted(frames.items()):
        key = key_of([(model, layer)])
        if key in state.done:
            continue
        try:
            rows = []
            for i in range(n_samples):
                sample = reduce_dimensions(top_by_draw(df, config.sample_rows, config.seed + i), "embed", config.dim, config.reduced)
                rows += [[model, layer, i, *map(_number, r)] for r in size_grid(sample, "row_id", "u", "entity", list(config.sizes)).collect()]
            best = max((r[6] for r in rows if r[6] is not None), default=None)
            state.finish(key, {"rows": rows, "score": best}, best)
        except ValueError as e:
            state.fail(key, e)
        if path:
            state.save(path)
    rows = [tuple(r) for k in sorted(state.summaries) for r in state.summaries[k]["rows"]]
    return spark.createDataFrame(rows, "model string, layer string, sample_idx int, min_cluster_size int, icm double, n_clusters int, dbcv double, ari double")


def _number(x):
    return None if isinstance(x, float) and x != x else x
