"""Readers, writers, state, estimators, drivers and the registry."""

import gzip
import json
import subprocess
import sys
from enum import Enum
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossweave.functions.vectors import cosine, is_usable, l2_normalise
from glossweave.operators import learning as ln
from glossweave.operators import vectors as vx
from glossweave.plans import pipeline as pl
from glossweave.sources import readers as rd
from glossweave.sources import writers as wr

DATA = Path("/root/testdata/sf0.001")


def test_names():
    assert [rd.file_kind(f"x.{s}") for s in ("parquet", "csv.gz", "tsv", "feather")] == ["parquet", "csv", "csv", "feather"]
    assert (rd.table_kind("a.tsv.gz"), rd.table_kind("a.csv"), rd.table_kind("a")) == ("tsv", "csv", "tsv")
    with pytest.raises(ValueError):
        rd.file_kind("x.doc")
    assert rd.model_and_layer("res_bert_12.parquet", "res") == ("bert", "12") and rd.model_and_layer("x", "res") == (None, None)
    models = ["biobert", "biobert-stsb"]
    assert rd.stem_model_layers("out_res_biobert_1_2_3.parquet", models) == ("biobert", "1,2,3")
    assert rd.stem_model_layers("res_biobert-stsb_1.parquet.gz", models) == ("biobert-stsb", "1")
    assert rd.stem_model_layers("mentions.parquet", models) is None
    assert rd.latest_version(["a.synthesis.2.csv", "a.synthesis.10.csv", "a.synthesis.2.diverse.csv"]) == ("a.synthesis.10.csv", 10)
    assert rd.latest_version([]) == (None, -1)


def test_text_tables(spark, tmp_path):
    p = tmp_path / "a.csv.gz"
    p.write_bytes(gzip.compress(b'PMID,Abstract\n12,"one,\ntwo"\n13,x\n'))
    assert rd.text_columns(str(p)) == (True, "PMID", "Abstract")
    assert {tuple(r) for r in rd.read_texts(spark, str(p)).collect()} == {("12", "one,\ntwo"), ("13", "x")}
    q = tmp_path / "b.tsv"
    q.write_text("5\tfirst\n6\tsecond\n")
    assert rd.text_columns(str(q))[0] is False
    assert rd.read_texts(spark, str(q)).count() == 2
    with pytest.raises(FileNotFoundError):
        rd.read_texts(spark, str(tmp_path / "none.csv"))
    texts = spark.createDataFrame([("1", "old", 1), ("1", "new", 2), ("2", "x", 3)], "pmid string, text string, n int")
    assert {tuple(r) for r in rd.texts_of(texts, texts.where("pmid = '1'").select("pmid"), "n").collect()} == {("1", "new")}


def test_documents(spark, tmp_path):
    files = {"w.json": json.dumps({"docs": [{"text": "a", "ground_truth": [{"a": 1}]}, "b"]}), "l.jsonl": '"c"\n\n{"body": "d"}\n', "bad.jsonl": '{"text": \nplain', "n.json": "17"}
    for n, t in files.items():
        (tmp_path / n).write_text(t)
    rows = rd.read_documents(spark, [str(tmp_path / n) for n in files]).orderBy("itext").collect()
    assert [r["text"] for r in rows] == ["a", "b", "c", "d", '{"text": \nplain', "17"] and [r["itext"] for r in rows] == list(range(6))
    assert json.loads(rows[0]["ground_truth"]) == [{"a": 1}]
    assert rd.parse_documents('{"text": "a", "body": "b"}') == [('{"text": "a", "body": "b"}', None)]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("1", "e", "m", [1.0, 2.0, 3.0]), ("2", "e", "m", [1.0])], "pmid string, entity string, mention string, embed array<double>")
    wr.write_mentions(df, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).select(F.sum(F.size("embed"))).first()[0] == 4
    with pytest.raises(ValueError):
        wr.write_any(df, str(tmp_path / "x.bin"))
    keyed = spark.createDataFrame([(1, "a")], "k int, v string")
    wr.merge_into(str(tmp_path / "t"), keyed, ["k"])
    wr.merge_into(str(tmp_path / "t"), spark.createDataFrame([(1, "b"), (2, "c")], "k int, v string"), ["k"])
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {(1, "b"), (2, "c")}
    kind = Enum("kind", "A B")
    assert wr.plain({kind.A: [float("nan"), np.int64(3), kind.B]}) == {"A": [None, 3, "B"]}
    wr.write_json({"x": float("inf")}, str(tmp_path / "j.json.gz"), "s.v1")
    assert rd.read_artifact(str(tmp_path / "j.json.gz"), "s.v1")["x"] is None
    with pytest.raises(ValueError):
        rd.read_artifact(str(tmp_path / "j.json.gz"), "s.v2")
    assert rd.read_optional(spark, str(tmp_path / "none.csv"), "csv") is None


def test_run_state(tmp_path):
    path = str(tmp_path / "state.json")
    s = pl.RunState.load(path, {"a": 1})
    s.finish("1:m/1", {"score": 0.5}, 0.5)
    s.finish("2:m/1+n/2", {"score": 0.9})
    s.fail("1:n/2", ValueError("x"))
    s.save(path)
    again = pl.RunState.load(path, {"a": 1})
    assert again.done == {"1:m/1", "2:m/1+n/2"} and again.score("2:m/1+n/2") == 0.9 and again.failures[0]["error"] == "x"
    assert again.drop_fusions() == 1 and again.done == {"1:m/1"}
    with pytest.raises(ValueError):
        pl.RunState.load(path, {"a": 2})
    assert pl.members_of(pl.key_of([("n", "2"), ("m", "1")])) == [("m", "1"), ("n", "2")]
    with pytest.raises(ValueError):
        pl.LinkerConfig(threshold=2)


def test_vector_columns(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([1.0, None],), ([float("nan"), 1.0],), (None,), ([1.0],)], "v array<double>")
    assert [r[0] for r in df.select(is_usable("v", 2)).collect()] == [True, False, False, False, False, False]
    unit = [r[0] for r in df.where("v IS NULL OR size(v) = 2").limit(2).select(l2_normalise("v")).collect()]
    assert unit == [[0.6, 0.8], [0.0, 0.0]]
    assert df.select(l2_normalise("v")).where("v IS NOT NULL OR true").count() == 6
    assert spark.range(1).select(cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0)))).first()[0] is None


def test_pca_properties(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 6)) @ np.diag([5, 3, 2, 1, 0.5, 0.1])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(999, None)], "id long, v array<double>")
    m = vx.PcaModel.fit(df, "v", 6, 3)
    assert m.components @ m.components.T == pytest.approx(np.eye(3), abs=1e-9) and (np.diff(m.variances) <= 0).all()
    rows = {r["id"]: r for r in m.transform(df, "v").collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    z = (u - m.mean) @ m.components.T
    assert rows[7]["pca_residual"] == pytest.approx(np.linalg.norm(u[7] - m.mean - z[7] @ m.components))
    assert rows[7]["pca_mahalanobis"] == pytest.approx(np.sqrt((z[7] ** 2 / m.variances).sum()))
    assert rows[999]["pca_residual"] is None and rows[999]["p"] is None
    with pytest.raises(ValueError):
        vx.PcaModel.fit(df.limit(0), "v", 6, 3)


def test_exact_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(90, 8))
    x[5] = x[6]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, embed array<double>")
    got = {(r["query"], r["rank"]): r["other"] for r in vx.nearest_exact(df.where("id < 20"), df, 3, 8).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(20):
        order = sorted((-round(float(u[q] @ u[j]), 9), j) for j in range(90) if j != q)
        assert [got[q, k] for k in (1, 2, 3)] == [j for _, j in order[:3]]
    assert vx.nearest_exact(df.limit(0), df, 3, 8).count() == 0


def blobs(n=60, seed=0):
    rng = np.random.default_rng(seed)
    return np.vstack([rng.normal(size=(n, 3)) * 0.2 + c for c in ((0, 0, 0), (6, 0, 0), (0, 6, 0))]), np.repeat([0, 1, 2], n)


def test_density_clusters():
    x, true = blobs()
    labels, member, dbcv = ln.density_clusters(np.vstack([x, [[30, 30, 30]]]), 10)
    assert labels[-1] == -1 and dbcv > 0.5 and ((member >= 0) & (member <= 1)).all()
    assert len({(a, b) for a, b in zip(labels[:-1], true) if a >= 0}) == 3
    labels, _, dbcv = ln.density_clusters(np.zeros((3, 2)), 10)
    assert (labels == -1).all() and np.isnan(dbcv)


def test_screeners(spark):
    x, t = blobs()
    df = spark.createDataFrame([(i, v.tolist(), int(c == 1)) for i, (v, c) in enumerate(zip(x, t))], "row_id long, v array<double>, y int")
    for model in (ln.fit_lda(df, "v", "y", 3), ln.fit_svm(df, "v", "y", 3), ln.fit_svm(df, "v", "y", 3, rbf=64, gamma=0.3)):
        rows = model.score(df, "v").collect()
        assert np.mean([(r["score"] > 0) == (r["y"] == 1) for r in rows]) > 0.97
    one_class = df.where("y = 0")
    assert {r["score"] for r in ln.fit_lda(one_class, "v", "y", 3).score(one_class, "v").collect()} == {0.0}
    assert {r["score"] for r in ln.fit_svm(one_class, "v", "y", 3).score(one_class, "v").collect()} == {0.0}
    with pytest.raises(ValueError):
        ln.fit_lda(df.limit(0), "v", "y", 3)


def test_linker_round_trip(spark, tmp_path):
    x, t = blobs(40)
    rows = [(i, ("a", "b", "negative")[c], "m", 1, i * 10, i * 10 + 5, i * 10, i * 10 + 5, v.tolist()) for i, (v, c) in enumerate(zip(x + 1, t))]
    df = spark.createDataFrame(rows, "row_id long, entity string, mention string, itext long, a long, b long, a_abs long, b_abs long, embed array<double>")
    kb = spark.createDataFrame([("A", "a"), ("B", "b")], "entity_id string, entity string")
    linker = pl.Linker.fit(df, kb, pl.LinkerConfig(dim=3, pca=2, reduced=2, sizes=(8, 12), sample_rows=200))
    linker.save(str(tmp_path / "l"))
    a = {tuple(r) for r in linker.predict(df).select("row_id", "entity_id").collect()}
    b = {tuple(r) for r in pl.Linker.load(spark, str(tmp_path / "l")).predict(df).select("row_id", "entity_id").collect()}
    assert a == b and a


def test_entities_outside_the_sample_are_assigned(spark):
    x, t = blobs(60)
    rows = [(i, ("a", "b", "negative")[c], v.tolist()) for i, (v, c) in enumerate(zip(x + 1, t))]
    out = {r["row_id"] for r in pl.top_by_draw(spark.createDataFrame([(i,) for i, e, _ in rows if e != "negative"], "row_id long"), 60, pl.LinkerConfig().seed).collect()}
    late = [i for i, e, _ in rows if e == "a" and i not in out][:6]
    df = spark.createDataFrame([(i, "late" if i in late else e, v) for i, e, v in rows], "row_id long, entity string, embed array<double>")
    kb = spark.createDataFrame([("A", "a"), ("B", "b"), ("L", "late")], "entity_id string, entity string")
    linker = pl.Linker.fit(df, kb, pl.LinkerConfig(dim=3, pca=2, reduced=2, sizes=(8, 12), sample_rows=60))
    assigned = {r["entity_id"]: r["cluster"] for r in linker.assignments.collect()}
    assert len(late) == 6 and assigned.keys() == {"A", "B", "L"} and assigned["L"] == assigned["A"] != assigned["B"]


def test_registry():
    import __spark_entry__ as e

    q, sql = e.queries(), e.oracle_sql()
    assert sql.keys() <= q.keys() and len(q) > 100 and "p1_found" in sql


def test_core_imports_without_the_subpackage(tmp_path):
    code = "import sys; sys.modules['glossweave.llm'] = None\nimport __spark_entry__ as e; q = e.queries(); assert 'p1_found' in q and 'p2_found' not in q"
    root = Path(__file__).resolve().parent.parent
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True).returncode == 0
    for p in (root / "glossweave").rglob("*.py"):
        if "llm" not in p.parts:
            assert "glossweave.llm" not in p.read_text(), p


def test_nearest_head_for_every_usable_mention(spark):
    import __spark_entry__ as e
    from glossweave.plans.frames_sql import usable_mentions

    d = "/root/testdata/sf0.01"
    got = e.queries()["e5_approximate_predict"](spark, d).collect()
    want = sorted(r["row_id"] for r in usable_mentions(spark, d).select("row_id").collect())
    assert sorted(r["row_id"] for r in got) == want and len(want) > 3000
    assert len({r["cluster"] for r in got}) > 1 and all(r["head"] is not None for r in got)


def test_vectors_of_all_texts(spark):
    import __spark_entry__ as e

    d = "/root/testdata/sf0.01"
    got = {r["doc"] for r in e.queries()["a30_text_embeddings"](spark, d).select("doc").distinct().collect()}
    want = {r["itext"] for r in spark.read.parquet(f"{d}/mention_frame.parquet").where("itext IS NOT NULL").select("itext").distinct().collect()}
    assert got == want and max(got) >= 400
