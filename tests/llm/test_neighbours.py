import numpy as np

from marlstone.llm import neighbours as nb

SCHEMA = "chunk_id string, embedding array<float>, v bigint, vec string, leaf int"


def brute(ids, x, k):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    out = set()
    for i in range(len(ids)):
        order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-round(s[i, j], 6), ids[j]))[:k]
        out |= {tuple(sorted((ids[i], ids[j]))) for j in order}
    return out


def pairs(spark, rows, **kw):
    return {tuple(r) for r in nb.nearest_pairs(spark.createDataFrame(rows, SCHEMA), "chunk_id", "embedding", 16, 5, **kw).collect()}


def test_recall(spark, monkeypatch):
    monkeypatch.setattr(nb, "CELL", 40)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((900, 16)).astype(np.float32)
    ids = [f"c{i:04}" for i in range(900)]
    got = pairs(spark, [(i, v.tolist(), 1, "", 2) for i, v in zip(ids, x)], degree=24)
    want = brute(ids, x.astype(np.float64), 5)
    assert len(got & want) / len(want) > 0.95 and len(got & want) / len(got) > 0.95


def test_a_third_are_copies(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((150, 16)).astype(np.float32)
    x[::3] = x[0]
    ids = [f"c{i:04}" for i in range(150)]
    assert pairs(spark, [(i, v.tolist(), 1, "", 2) for i, v in zip(ids, x)]) == brute(ids, x.astype(np.float64), 5)


def test_unusable_vectors_and_repeats(spark):
    good = [1.0] + [0.5] * 15
    other = [0.5] + [1.0] * 15
    rows = [("a", good, 1, "", 1), ("a", good, 1, "", 1), ("b", other, 1, "", 1), ("c", None, 1, "", 1), ("d", [0.0] * 16, 1, "", 1), ("e", [1.0] * 15, 1, "", 1),
            ("f", [float("nan")] + [1.0] * 15, 1, "", 1), (None, good, 1, "", 1), ("g", [None] + [1.0] * 15, 1, "", 1), ("h", [float("inf")] * 16, 1, "", 1)]
    assert pairs(spark, rows) == {("a", "b")}
    assert pairs(spark, rows[:1]) == set()
    assert pairs(spark, []) == set()


def test_search(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((500, 16)).astype(np.float32)
    rows = spark.createDataFrame([(f"c{i:04}", v.tolist(), 1, "", 2) for i, v in enumerate(x)], SCHEMA)
    graph = nb.Graph(rows, "chunk_id", "embedding", 16, degree=24)
    got = {(r[0], r[1]) for r in graph.search(rows.where("chunk_id like '%00'"), "chunk_id", "embedding", 16, 5).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(f"c{i:04}", f"c{j:04}") for i in range(0, 500, 100) for j in np.argsort(-(u @ u[i]))[:5]}
    assert len(got & want) / len(want) >= 0.9


def test_search_reaches_every_part_and_leaves_the_query_out(spark):
    # 100 tight groups far from one another: with few neighbours a vector, most hold none of a few first vectors
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((100, 16))
    x = (np.repeat(centres, 8, 0) + 0.01 * rng.standard_normal((800, 16))).astype(np.float32)
    rows = spark.createDataFrame([(f"c{i:04}", v.tolist(), 1, "", 2) for i, v in enumerate(x)], SCHEMA)
    graph = nb.Graph(rows, "chunk_id", "embedding", 16, degree=6)
    got = [(r[0], r[1]) for r in graph.search(rows.where("chunk_id like '%0'"), "chunk_id", "embedding", 16, 5, 8, others_only=True).collect()]
    u = x.astype(np.float64) / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(f"c{i:04}", f"c{j:04}") for i in range(0, 800, 10) for j in [j for j in np.argsort(-(u @ u[i])) if j != i][:5]}
    assert len(got) == 400 and all(a != b for a, b in got)
    assert len(set(got) & want) / len(want) >= 0.97
