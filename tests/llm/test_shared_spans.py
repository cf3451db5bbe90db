import random
from collections import defaultdict

import pytest

from marlstone.llm import shared_spans as ss

SCHEMA = "doc_id bigint, text string, doc string, hash string, id string"


def brute(rows, span):
    at = defaultdict(set)
    for i, t, *_ in rows:
        if i is not None and t is not None:
            for k in range(len(t) - span + 1):
                at[t[k:k + span]].add(i)
    pairs, cover = set(), {}
    for v in at.values():
        v = sorted(v)
        pairs |= {(a, b) for k, a in enumerate(v) for b in v[k + 1:]}
    for i, t, *_ in rows:
        if i is not None and t is not None:
            end = n = 0
            for k in range(len(t)):
                if k + span <= len(t) and len(at[t[k:k + span]]) > 1:
                    end = k + span
                n += k < end
            if n:
                cover[i] = n
    return pairs, cover


def sample(seed, n=60, shared=12):
    rng = random.Random(seed)
    alphabet = "abcde é\n"
    pool = ["".join(rng.choices(alphabet, k=rng.randrange(20, 90))) for _ in range(shared)]
    rows = []
    for i in range(n):
        t = "".join(rng.choice(pool) if rng.random() < 0.5 else "".join(rng.choices(alphabet, k=rng.randrange(40))) for _ in range(rng.randrange(8)))
        rows.append((i, t, "x", "y", "z"))
    return rows + [(n + k, rows[k][1], "", "", "") for k in range(5)]


@pytest.mark.parametrize("few, seed", [(32, 1), (32, 2), (1, 1), (1, 3)])
def test_against_brute_force(spark, monkeypatch, few, seed):
    monkeypatch.setattr(ss, "FEW_CONTEXTS", few)
    monkeypatch.setattr(ss, "PHRASES_PER_SHARD", 7)
    monkeypatch.setattr(ss, "TEXTS_PER_TASK", 5)
    rows = sample(seed)
    spans = ss.SharedSpans(spark.createDataFrame(rows, SCHEMA), 40, 20)
    pairs, cover = brute(rows, 40)
    assert len(pairs) > 30
    assert {tuple(r) for r in spans.pairs().collect()} == pairs
    assert {r["doc_id"]: r["shared_chars"] for r in spans.coverage().collect()} == cover


def test_monotone_text_and_edges(spark):
    rows = [(1, "a" * 3000, "", "", ""), (2, "b" + "a" * 500, "", "", ""), (3, "a" * 39, "", "", ""), (4, None, "", "", ""), (5, "", "", "", ""), (None, "a" * 99, "", "", ""),
            (6, "c" * 40, "", "", ""), (7, "c" * 40, "", "", ""), (7, "c" * 40, "", "", "")]
    spans = ss.SharedSpans(spark.createDataFrame(rows, SCHEMA), 40, 20)
    assert {tuple(r) for r in spans.pairs().collect()} == {(1, 2), (6, 7)}
    assert {r["doc_id"]: r["shared_chars"] for r in spans.coverage().collect()} == {1: 3000, 2: 500, 6: 40, 7: 40}


def test_any_id(spark):
    low, high = -(1 << 63), (1 << 63) - 1
    rows = [(i, x + "a" * 420, "", "", "") for i, x in ((-5, "b"), (7, "c"), (low, "d"), (high, "e"), (-1, "f"), (0, "g"))]
    spans = ss.SharedSpans(spark.createDataFrame(rows, SCHEMA))
    ids = sorted(r[0] for r in rows)
    assert {tuple(r) for r in spans.pairs().collect()} == {(a, b) for k, a in enumerate(ids) for b in ids[k + 1:]}
    assert {r["doc_id"]: r["shared_chars"] for r in spans.coverage().collect()} == dict.fromkeys(ids, 420)


def test_empty(spark):
    spans = ss.SharedSpans(spark.createDataFrame([], SCHEMA))
    assert spans.pairs().count() == 0 and spans.coverage().count() == 0
