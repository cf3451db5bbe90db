import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.config import SETTINGS, Settings, embedding_dimension
from marlstone.operators import confidence, index, retrieve


QUERIES = ("hybrid_blend", "hybrid_retrieve")


def bm25(docs, query, k1=1.5, b=0.75, eps=0.25):
    n, avgdl = len(docs), sum(map(len, docs)) / len(docs)
    df = Counter(t for d in docs for t in set(d))
    idf = {t: math.log(n - v + 0.5) - math.log(v + 0.5) for t, v in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {t: v if v >= 0 else eps * mean for t, v in idf.items()}
    out = []
    for d in docs:
        tf = Counter(d)
        out.append(sum(idf.get(t, 0) * tf[t] * (k1 + 1) / (tf[t] + k1 * (1 - b + b * len(d) / avgdl)) for t in query))
    return out


def test_bm25_with_negative_weights_and_repeated_terms(spark, tmp_path):
    rng = random.Random(1)
    docs = [[rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))] + ["all"] * (i % 3 != 0) for i in range(20)]
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)] + [(20, None)], "id int, t string")
    built = index.build(df, "id", "t")
    built.save(str(tmp_path / "index"))
    built = index.BM25Index.load(spark, str(tmp_path / "index"))
    asked = spark.createDataFrame([(0, "a a all b"), (1, "unknown"), (2, None)], "q int, t string")
    got = {(r["query_id"], r["id"]): r["score"] for r in index.scores(built, index.query_terms(asked, "q", "t")).collect()}
    want = bm25(docs + [[]], ["a", "a", "all", "b"])
    for i, s in enumerate(want):
        assert got.get((0, i), 0) == pytest.approx(s, abs=2e-6)
    assert not any(q for q, _ in got)
    top = index.top_k(index.scores(built, index.query_terms(asked, "q", "t")), 3).orderBy("rank").collect()
    assert [r["id"] for r in top] == sorted(range(20), key=lambda i: (-round(want[i], 6), i))[:3]
    assert index.normalise(index.top_k(index.scores(built, index.query_terms(asked, "q", "t")), 3)).agg(F.max("bm25")).first()[0] == 1.0


def test_search_moves_only_the_best_of_each_task(spark, monkeypatch):
    """As top_k of all scores: ties, negative and no weights, NULL texts, several blocks of queries and of documents, terms beside the matrix, ids given twice."""
    from marlstone.plans import retrieval

    monkeypatch.setattr(index, "SEARCH_TERMS", 40)
    monkeypatch.setattr(index, "HOT_TERMS", 3)
    monkeypatch.setattr(index, "SIDE", 7)
    rng = random.Random(3)
    texts = [" ".join(["all"] * (i % 3 != 0) + [rng.choice("abcdefghij") for _ in range(rng.randrange(9))]) for i in range(60)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(60 + i, texts[i]) for i in range(20)] + [(80, None), (81, ""), (None, "a b")]
    for rows in (docs, [(i, t and "a a c") for i, t in docs], docs + [(5, "b c d")], docs[:2], [], [(i, None) for i, _ in docs]):
        df = spark.createDataFrame(rows, "id int, t string").repartition(3)
        asked = index.query_terms(df.where("id % 4 = 0").unionByName(spark.createDataFrame([(1000, "a a all zz"), (1001, "zz"), (1002, None)], "id int, t string")), "id", "t")
        want = index.top_k(index.scores(index.build(df, "id", "t"), asked), 5).select("query_id", "id", "score", "rank").collect()
        got = index.search(df, "id", "t", asked, 5).select("query_id", "id", "score", "rank").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    plan = retrieval.rrf_fusion(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and plan.count("keys=[query_id") <= 2  # only the fusion itself groups by query and document


def test_blended_queries_alone_are_scored(spark, tmp_path, monkeypatch):
    """Documents have queries that the vectors lack: none of their terms goes to the texts."""
    from marlstone.plans import retrieval

    spark.createDataFrame([(i, f"w{i % 7} all", "Other") for i in range(1000)], "doc_id bigint, text string, doc_type string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, [1.0, float(i)], 0) for i in range(130)], "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    seen, search = [], index.search
    monkeypatch.setattr(index, "search", lambda docs, i, t, terms, k: seen.append({r[0] for r in terms.select("query_id").collect()}) or search(docs, i, t, terms, k))
    for query in QUERIES:
        assert retrieval.QUERIES[query](spark, str(tmp_path)).count() > 0
    assert seen == [{0, 100}] * len(QUERIES)


def greedy(rel, x, k, weight):
    chosen = []
    while len(chosen) < k:
        best, at = -9e9, None
        for i in range(len(rel)):
            if i not in chosen:
                s = weight * rel[i] - (1 - weight) * max((float(x[i] @ x[j]) for j in chosen), default=0.0)
                if s > best + 1e-10:
                    best, at = s, i
        chosen.append(at)
    return chosen


def test_knn_and_mmr(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((60, 8))
    x[7] = x[3]
    rows = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(x)] + [(60, [0.0] * 8, 0), (61, None, 0)], "id int, vec array<double>, half int")
    asked = rows.where("id < 3").select(F.col("id").alias("query_id"), F.col("vec").alias("q_vec"))
    near = retrieve.knn(asked, rows, 12)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(3):
        got = [r["id"] for r in near.where(F.col("query_id") == q).orderBy("rank").collect()]
        assert got == [int(i) for i in sorted(range(60), key=lambda i: (round(1 - float(u[q] @ u[i]), 9), i))[:12]]
    assert {r["id"] % 2 for r in retrieve.knn(asked, rows, 5, F.col("half") == 1).collect()} == {1}
    from marlstone.functions.vector import l2_normalize

    cand = near.join(rows.select("id", l2_normalize(F.col("vec")).alias("vec")), "id").withColumn("relevance", F.col("similarity"))
    for weight in (0.5, 0.95):
        got = retrieve.mmr(cand, 6, weight).orderBy("query_id", "mmr_rank").collect()
        for q in range(3):
            c = near.where(F.col("query_id") == q).orderBy("rank").collect()
            order = greedy([r["similarity"] for r in c], u[[r["id"] for r in c]], 6, weight)
            assert [r["id"] for r in got if r["query_id"] == q] == [c[k]["id"] for k in order]
    few = retrieve.mmr(cand.where("rank <= 3"), 6)
    assert [r["mmr_rank"] for r in few.where("query_id = 0").orderBy("mmr_rank").collect()] == [1, 2, 3]


def test_blend_and_fusion(spark):
    dense = spark.createDataFrame([(1, 1, 0.8, 1), (1, 2, 0.6, 2)], "query_id int, id int, similarity double, rank int")
    sparse = spark.createDataFrame([(1, 2, 1.0, 1), (1, 3, 0.5, 2)], "query_id int, id int, bm25 double, rank int")
    got = {r["id"]: r["score"] for r in retrieve.blend(dense, sparse).collect()}
    assert got == {1: 0.8, 2: 0.7}
    fused = {r["id"]: r["score"] for r in retrieve.rrf(dense, sparse).collect()}
    assert fused[2] == pytest.approx(1 / 62 + 1 / 61, abs=1e-9) and set(fused) == {1, 2, 3}


def python_confidence(rows):
    s = sorted((x for x, _ in rows), reverse=True)
    wm = round(sum(x / r for r, x in enumerate(s, 1)) / sum(1 / r for r in range(1, len(s) + 1)), 9)
    clamp = lambda v: max(0.0, min(1.0, v))
    quality = s[0] * 0.5 if s[0] < 0.45 else wm * 0.85 if s[0] < 0.7 else wm * 1.08 if s[-1] >= 0.7 else wm
    auth = np.mean([SETTINGS.authority.get(t, 0.4) for _, t in rows])
    agreement = clamp(1 - np.std(s, ddof=1) / 0.3) if len(s) > 1 else 0.5
    coverage = clamp(sum(x >= 0.7 for x in s) / 3)
    return 0.45 * clamp(quality) + 0.25 * clamp(auth) + 0.2 * agreement + 0.1 * coverage


def test_confidence(spark):
    rng = random.Random(2)
    sets = {q: [(round(rng.random(), 4), rng.choice(["Customs Act", "Case Law", "unknown", None])) for _ in range(rng.randrange(1, 7))] for q in range(60)}
    sets[60] = [(0.45, "Other")]
    sets[61] = [(0.70, "Customs Act")] * 3
    sets[62] = [(0.4499, "Other"), (0.1, "Other")]
    df = spark.createDataFrame([(q, s, t) for q, v in sets.items() for s, t in v], "query_id int, similarity double, doc_type string")
    got = {r["query_id"]: r for r in confidence.signals(df).collect()}
    for q, v in sets.items():
        assert got[q]["confidence_score"] == pytest.approx(python_confidence(v), abs=6e-4)
    assert got[61]["coverage_bonus"] == 1.0 and got[60]["source_agreement"] == 0.5
    every = confidence.with_empty(spark.createDataFrame([(61,), (99,)], "query_id int"), confidence.signals(df))
    assert {r["query_id"]: r["confidence_score"] > 0 for r in every.collect()} == {61: True, 99: False}


def test_review_reason(spark):
    rows = [(0.5, 0.9, 3, "one two three four"), (0.95, 0.3, 3, "one two three four"), (0.95, 0.9, 0, "one two three four"), (0.95, 0.9, 1, " a b c "), (0.95, 0.9, 1, ""),
            (0.95, 0.9, 1, "one two three four"), (0.125, 0.9, 1, "x")]
    df = spark.createDataFrame(rows, "s double, t double, n int, q string")
    got = [r[0] or "" for r in df.select(confidence.review_reason(F.col("s"), F.col("t"), F.col("n"), F.col("q"))).collect()]
    assert [g[:12] for g in got] == ["Confidence s", "Best retriev", "No strongly ", "Query is ver", "", "", "Confidence s"]
    assert "0.13" in got[-1]


def test_settings():
    for bad in ({"chunk_overlap": 900}, {"top_k": 0}, {"dense_weight": 2}, {"weak": 0.9}, {"confidence_weights": (1, 1, 0, 0)}):
        with pytest.raises(ValueError):
            Settings(**bad)
    assert SETTINGS.fetch_k == 24 and embedding_dimension("nomic-embed-text") == 768
    with pytest.raises(ValueError):
        embedding_dimension("none")
