import random

from marlstone.llm import leaks

DOCS = "doc_id bigint, text string, item_id string, passage string"
ITEMS = "item_id bigint, question string, passage string, text string"


def brute(docs, items, run=12):
    out = set()
    for d, t, *_ in docs:
        w = leaks.words(t or "")
        grams = {tuple(w[i:i + run]) for i in range(len(w) - run + 1)}
        for i, _, p, *_ in items:
            x = leaks.words(p or "")
            if any(tuple(x[k:k + run]) in grams for k in range(len(x) - run + 1)):
                out.add((d, i))
    return out


def found(spark, docs, items, **kw):
    df = leaks.find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), **kw)
    return {(r[0], r[1]) for r in df.collect()}


def sample(seed):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7)) % 200}" for _ in range(4000)]
    items = [(i, "what is w1", " ".join(rng.choices(words, k=rng.randrange(8, 40))), "z") for i in range(60)]
    docs = []
    for d in range(200):
        w = rng.choices(words, k=rng.randrange(0, 300))
        for _ in range(rng.randrange(3)):
            p = leaks.words(rng.choice(items)[2])
            n = rng.randrange(8, 20)
            a, at = rng.randrange(len(p)), rng.randrange(len(w) + 1)
            w[at:at] = p[a:a + n]
        docs.append((d, ",\n".join(w).upper(), "q", "r"))
    return docs, items


def test_against_brute_force(spark):
    docs, items = sample(1)
    want = brute(docs, items)
    assert len(want) > 20
    assert found(spark, docs, items) == want
    assert found(spark, docs, items, width=12) == want
    assert found(spark, docs, items, block_bytes=2000) == want


def test_search_finds_all_above_the_threshold():
    _, items = sample(2)
    index = leaks.Index([i[:3] for i in items], 12)
    rng = random.Random(4)
    for _ in range(200):
        terms = set(rng.sample(sorted(index.postings), 20))
        scores = {}
        for t in terms:
            for i, s in zip(index.postings[t].items, index.postings[t].scores):
                scores[i] = scores.get(i, 0) + s
        assert sorted(index.search(terms)) == sorted(i for i, s in scores.items() if s >= 1 - 1e-9)


def test_nulls_empty_and_repeats(spark):
    p = " ".join(f"word{i}" for i in range(14))
    items = [(1, None, p, ""), (1, None, p, ""), (2, "q", None, ""), (None, "q", p, ""), (3, "q", "too short", ""), (4, "q", "", "")]
    docs = [(1, p, "", ""), (1, p, "", ""), (2, None, "", ""), (3, "", "", ""), (4, "x " * 20000 + p, "", "")]
    assert found(spark, docs, items) == {(1, 1), (4, 1)}
    assert found(spark, [], items) == set() and found(spark, docs, []) == set()
