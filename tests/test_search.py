import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvellum.operators import ranking, retrieval


def rankings(spark, *lists):
    rows = [("q", x, r, n) for n, ids in enumerate(lists) for r, x in enumerate(ids, 1)]
    return spark.createDataFrame(rows, "query_id string, id string, rank int, list_no int")


def test_fusion(spark):
    got = {r.id: r.score for r in ranking.rrf_fuse(rankings(spark, "abc", "dbe")).collect()}
    assert got["b"] == pytest.approx(2 / 62) and got["a"] == got["d"] == pytest.approx(1 / 61)
    got = {r.id: r.score for r in ranking.rrf_fuse(rankings(spark, "abc", "cba")).collect()}
    assert got["a"] == pytest.approx(1 / 61 + 1 / 63) and got["b"] == pytest.approx(2 / 62) and got["a"] > got["b"]


@pytest.mark.parametrize("lists,k,want", [((["a1", "a2", "a3"], ["b1", "b2"]), 4, ["a1", "b1", "a2", "b2"]), ((["s1", "a1"], ["s1", "b1"]), 4, ["s1", "a1", "b1"]), ((["a0", "a1", "a2", "a3", "a4"], ["b1"]), 3, ["a0", "b1", "a1"]), (([], []), 3, [])])
def test_interleaving(spark, lists, k, want):
    assert [r.id for r in ranking.interleave(rankings(spark, *lists), k).orderBy("place").collect()] == want


def test_caps(spark):
    hits = rankings(spark, ["a1", "b1", "a2", "c1"]).withColumn("paper", F.left("id", F.lit(1)))
    assert [r.id for r in ranking.cap_per_group(hits, "paper", 1, 3).orderBy("place").collect()] == ["a1", "b1", "c1"]
    assert [r.id for r in ranking.cap_per_group(hits, "paper", None, 3).orderBy("place").collect()] == ["a1", "b1", "a2"]


def test_first_appearances(spark):
    rows = rankings(spark, ["x", "y", "x", "z"])
    assert [(r.id, r.rank) for r in ranking.first_appearances(rows, "id").orderBy("rank").collect()] == [("x", 1), ("y", 2), ("z", 3)]


DOCS = {"a": "the parser reads the index of the parser", "b": "an index of papers", "c": "the the the", "d": "", "e": "éclair parser"}


def corpus(spark):
    vectors = {"a": [1.0, 0.0, 0.0], "b": [0.0, 1.0, 0.0], "c": [0.0, 0.0, 1.0], "d": [0.0, 0.0, 0.0], "e": None}
    rows = [(k, k[0], {"a": 2021, "b": 2023}.get(k), t, vectors[k]) for k, t in DOCS.items()]
    return spark.createDataFrame(rows + [("n", "n", 2020, None, None)], "id string, paper_id string, year int, text string, vector array<float>")


def okapi(query):
    docs = {k: re.findall("[a-z0-9]+", t.lower()) for k, t in DOCS.items()}
    mean = sum(map(len, docs.values())) / len(docs)
    df = {}
    for words in docs.values():
        for w in set(words):
            df[w] = df.get(w, 0) + 1
    raw = {w: math.log(len(docs) - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    idf = {w: floor if v < 0 else v for w, v in raw.items()}
    return {k: sum(idf.get(w, 0) * words.count(w) * 2.5 / (words.count(w) + 1.5 * (0.25 + 0.75 * len(words) / mean)) for w in query.split()) for k, words in docs.items()}


def test_bm25(spark):
    asked = spark.createDataFrame([("q", "the parser index parser", "x"), ("n", None, "x"), ("e", "", "x")], "query_id string, text string, term string")
    got = {r.id: r.score for r in retrieval.bm25_ranking(corpus(spark), asked, 10).collect()}
    want = {k: v for k, v in okapi("the parser index parser").items() if v > 0}
    assert got == pytest.approx(want, abs=1e-6)
    joined = {r.id: r.score for r in retrieval.bm25_scores(corpus(spark), asked).collect()}
    assert joined == pytest.approx(want, abs=1e-9)
    recent = retrieval.bm25_ranking(corpus(spark), asked, 10, retrieval.scope(year_min=2022)).collect()
    assert [(r.id, r.rank) for r in recent] == [("b", 1)] and recent[0].score == pytest.approx(want["b"], abs=1e-6)


def test_bm25_over_blocks_and_batches(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(30)]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words, rng.integers(1, 40)))) for i in range(400)], "id bigint, text string").repartition(3)
    asked = spark.createDataFrame([(i, " ".join(rng.choice(words, 4))) for i in range(20)], "query_id bigint, text string")
    scores = retrieval.bm25_scores(docs, asked).withColumn("score", F.round("score", 6))
    want = {(r.query_id, r.rank): (r.id, r.score) for r in ranking.top_k(scores, 7, [F.col("score").desc(), "id"]).collect()}
    for block in (2048, 4):
        got = {(r.query_id, r.rank): (r.id, r.score) for r in retrieval.bm25_ranking(docs, asked, 7, block=block).collect()}
        assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}


def test_scope_treats_unknown_years_as_zero(spark):
    ids = lambda keep: {r.id for r in corpus(spark).where(keep).collect()}
    assert ids(retrieval.scope(year_max=2021)) == {"a", "c", "d", "e", "n"} and ids(retrieval.scope("b")) == {"b"} and ids(retrieval.scope("")) == {*DOCS, "n"}


def test_dense_blocks_and_ties(spark):
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(60, 4)).round(1)
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(99, None)], "id bigint, vector array<float>").repartition(5)
    asked = rows.where("id % 7 = 0").withColumnRenamed("id", "query_id")
    norm = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    for block in (4096, 3):
        got = {(r.query_id, r.rank): r.id for r in retrieval.dense_ranking(rows, asked, 5, block=block).collect()}
        for q in range(0, 60, 7):
            cosine = (norm @ norm[q]).round(6)
            want = sorted(range(60), key=lambda i: (-cosine[i], i))[:5]
            assert [got[q, n] for n in range(1, 6)] == want
    assert retrieval.dense_ranking(rows.limit(0), asked, 5).count() == 0 == retrieval.dense_ranking(rows, asked.limit(0), 5).count()


def test_hybrid_modes(spark):
    asked = spark.createDataFrame([("q", "index papers", [0.9, 0.1, 0.0])], "query_id string, text string, vector array<float>")
    order = lambda mode: [r.id for r in retrieval.hybrid_search(corpus(spark), asked, 2, mode).orderBy("rank").collect()]
    assert order("dense")[0] == "a" and order("bm25")[0] == "b" and set(order("hybrid")) == {"a", "b"}
    with pytest.raises(ValueError):
        order("sparse")


def test_reranking(spark):
    hits = rankings(spark, ["a1", "b1", "a2", "c1"]).withColumn("paper_id", F.left("id", F.lit(1)))
    scores = spark.createDataFrame([("q", "a1", 0.1), ("q", "b1", 0.500001), ("q", "a2", 0.5000012), ("q", "c1", 0.9)], "query_id string, id string, model_score double")
    order = lambda most: [r.id for r in retrieval.rerank(hits, scores, 3, most).orderBy("place").collect()]
    assert order(None) == ["c1", "b1", "a2"] and order(1) == ["c1", "b1", "a2"]
