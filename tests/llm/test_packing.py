import os
import random
from collections import Counter, defaultdict

import pytest

from marlstone.llm import packing


def bins_of(plan, counts):
    bins = defaultdict(list)
    for s, segments in plan.segments.items():
        rank = 0
        for a, n, first, each in sorted(segments):
            assert a == rank
            rank += n
            for k in range(n):
                bins[first + k // each].append(s)
        assert rank == counts[s]
    return bins


def test_plan_packs_everything_about_as_well_as_first_fit():
    rng = random.Random(1)
    for _ in range(400):
        capacity = rng.choice([5, 10, 30, 100, 2048])
        sizes = [rng.randint(1, capacity if rng.random() < 0.5 else max(1, capacity // 3)) for _ in range(rng.choice([0, 1, 2, 5, 50, 300]))]
        counts = Counter(sizes)
        plan = packing.Plan(dict(counts), capacity)
        bins = bins_of(plan, counts)
        assert sum(map(len, bins.values())) == len(sizes) and set(bins) == set(range(plan.containers))
        assert all(sum(b) <= capacity for b in bins.values())
        first_fit = []
        for s in sorted(sizes, reverse=True):
            for k, used in enumerate(first_fit):
                if used + s <= capacity:
                    first_fit[k] += s
                    break
            else:
                first_fit.append(s)
        assert plan.containers <= len(first_fit) + 1


def test_plan_of_a_billion_items():
    rng = random.Random(2)
    counts = {s: rng.randrange(10**6) for s in range(1, 2049)}
    plan = packing.Plan(dict(counts), 2048)
    least = -(-sum(s * n for s, n in counts.items()) // 2048)
    assert least <= plan.containers < 1.01 * least and plan.fixed > 0


def test_table(spark, monkeypatch):
    monkeypatch.setattr(packing, "ROWS_PER_RANKING", 10)
    rng = random.Random(3)
    rows = [(i, rng.choice([0, 7, 7, 7, 30, 55, 99, 100, 101, 250]), "x", 5) for i in range(300)] + [(301, None, "x", 1), (None, 5, "x", 1), (302, -3, "x", 1), (0, 1, "x", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, tokens bigint, id string, part int")
    got = packing.pack(df, 100).collect()
    want = {}
    for i, t, *_ in rows:
        if i is not None:
            want[i] = max(want.get(i, 0), t or 0)
    total = defaultdict(int)
    for r in got:
        total[r["doc_id"]] += r["tokens"]
    assert dict(total) == want
    assert Counter(r["doc_id"] for r in got) == Counter({i: max(1, -(-t // 100)) for i, t in want.items()})
    filled = defaultdict(int)
    for r in got:
        filled[r["container"]] += r["tokens"]
    assert max(filled.values()) <= 100 and len(filled) <= 1.05 * sum(want.values()) / 100 + 1
    assert packing.pack(spark.createDataFrame([], df.schema), 100).count() == 0


@pytest.mark.skipif(not os.path.exists(packing.TOKENIZER), reason="needs the vocabulary file")
def test_sizes(spark):
    df = spark.createDataFrame([(1, "The duty is five percent."), (2, None), (3, ""), (4, "a" * 5000), (None, "x"), (1, "The duty")], "doc_id bigint, text string")
    got = dict(tuple(r) for r in packing.token_sizes(df).collect())
    assert got[1] == 6 and got[2] == got[3] == 0 and got[4] > 100 and set(got) == {1, 2, 3, 4}
