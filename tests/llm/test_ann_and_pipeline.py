import math
import random

import numpy as np
import pytest

import corpus_pipeline
from ledgerstone.llm import ann, queries


def exact(rows, q, k=10):
    x = [v for i, v in rows if i == q][0]
    d = sorted((math.dist(v, x), i) for i, v in rows if i != q)
    return d[:k]


def test_recall_and_scores(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = queries.op8_nearest(spark, sf_dir).collect()
    asked = [i for i, _ in rows if i % 100 == 0]
    hits = 0
    for q in asked:
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11))
        at = dict(rows)
        assert all(r["score"] == pytest.approx(math.dist(at[r["vec_id"]], at[q]), rel=1e-12) for r in mine)
        hits += len({r["vec_id"] for r in mine} & {i for _, i in exact(rows, q)})
    assert hits >= 0.9 * 10 * len(asked)


def test_awkward_vectors(spark):
    rng = random.Random(3)
    hot = [1.0, 2.0, 3.0]
    rows = [(i, hot) for i in range(0, 900, 3)] + [(1000 + i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(200)]
    bad = [(5000, None), (5100, []), (5200, [0.0] * 3), (5300, [1.0, None, 2.0]), (5400, [1.0, float("nan"), 2.0]), (5500, [1.0, float("inf"), 2.0]), (5600, [1.0, 2.0]), (None, [1.0, 1.0, 1.0])]
    t = spark.createDataFrame([(i, v, 0, "x") for i, v in rows + bad], "vec_id long, embedding array<double>, leaf int, qkey string")
    got = ann.search(t).collect()
    assert {r["query_id"] for r in got} == {i for i, _ in rows if i % 100 == 0}
    same = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == 300)
    assert same == [(k + 1, 3 * k, 0.0) for k in range(10)]
    own = sorted((r["rank"], r["vec_id"]) for r in got if r["query_id"] == 0)
    assert own == [(k + 1, 3 * k + 3) for k in range(10)]
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in ann.search(few).collect()] == [(0, 1, 1, math.sqrt(2))]
    assert ann.search(few.limit(0)).count() == 0


def test_tree_visits_every_leaf_once():
    x = np.random.default_rng(1).normal(size=(3000, 8))
    tree = ann.Tree(x)
    seen = [leaf for _, leaf in tree.best_first(x[0], 10**9)]
    assert sorted(seen) == sorted(tree.leaf_of.values())
    assert seen[0] == tree.leaves(x[:1])[0] or tree.leaves(x[:1])[0] in seen[:5]


def test_no_row_to_ask_for(spark):
    t = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (100, None)], "vec_id long, embedding array<double>")
    assert ann.search(t).collect() == []


def test_tree_grows_with_the_table(spark):
    """Leaves of more than 60 vectors are split on their own members; neighbours are still found."""
    x = np.random.default_rng(2).normal(size=(4000, 6))
    x[:700] = x[0] + 1e-3 * x[:700]  # a crowded place
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    tree = ann.Tree(x[:200])
    points = ann.cut(spark.createDataFrame([(int(n), v, [i]) for n, (i, v) in zip(tree.leaves(x), rows, strict=True)], "leaf long, embedding array<double>, ids array<bigint>"), "test")
    finer, centres = ann._split(points, 1, 60)
    assert centres.count() > 0 and sorted(r["ids"][0] for r in finer.collect()) == list(range(4000))
    assert finer.groupBy("leaf").count().agg({"count": "max"}).first()[0] < points.groupBy("leaf").count().agg({"count": "max"}).first()[0]
    got = ann.search(t, group=60).collect()
    hits = 0
    for q in range(0, 4000, 100):
        mine = {r["vec_id"]: r["score"] for r in got if r["query_id"] == q}
        want = exact(rows, q)
        assert len(mine) == 10 and all(d == pytest.approx(math.dist(x[v], x[q]), rel=1e-12) for v, d in mine.items())
        hits += len(set(mine) & {i for _, i in want})
    assert hits >= 0.9 * 10 * 40


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.cut(stage(spark, docs, sf_dir), "test")
        if name != "best-fit packing":
            assert out.columns == corpus_pipeline.COLUMNS
            ids = [r["doc_id"] for r in out.collect()]
            assert len(ids) == len(set(ids)) and set(ids) <= {r["doc_id"] for r in docs.collect()}
        counts.append(out.count())
        docs = out
    assert counts[0] > counts[1] and counts[1] >= counts[2] >= counts[3] >= counts[4] > 0
    assert docs.groupBy("sequence_id").sum("length").selectExpr("max(`sum(length)`)").first()[0] <= 1024


def test_pipeline_on_awkward_rows(spark, sf_dir, tmp_path):
    """Nulls in any column, blanks, repeated rows, copies, an empty label table."""
    long = " ".join(f"w{i % 97}x{i}" for i in range(3000))
    rows = [(None, "a text of no number but with some words in it", None, None, None), (1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, long, "en", None, 5), (3, long, "en", None, 5), (4, long, "de", "s", 5), (5, " \n ", "en", "s", 3), (6, "short and new", None, "s", 13)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "short and new"), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} == {None, 1, 2, 3, 5, 6}
    assert len({(r["doc_id"], r["piece"]) for r in out}) == len(out)
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_near_dedup_stage_keeps_unlike_texts_of_one_id(spark, sf_dir):
    a, b, c = (" ".join(f"{k}{i}" for i in range(40)) for k in "abc")
    docs = [(None, a), (None, b), (None, b + " more"), (1, a), (1, c), (1, c), (2, "only here")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir).select("doc_id", "text").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, a), (None, b), (1, c), (2, "only here")], key=str)
