import random
import re
from collections import defaultdict

from marlstone.llm import repeated_lines as rl

SCHEMA = "parsed_id bigint, raw_text string, source_name string, lines string, key string"


def brute(rows, min_docs=8, min_letters=20):
    at = defaultdict(set)
    for i, text, source, *_ in rows:
        if text is not None and source is not None:
            for n, line in enumerate(text.split("\n"), 1):
                k = "".join(c for c in line.lower() if c.isalpha())
                if len(k) >= min_letters:
                    at[source, k].add((i, n))
    return {x for v in at.values() if len({i for i, _ in v}) >= min_docs for x in v}


def found(spark, rows, **kw):
    return {tuple(r) for r in rl.repeated_line_positions(spark.createDataFrame(rows, SCHEMA), **kw).collect()}


def test_against_brute_force_with_a_hot_source(spark):
    rng = random.Random(3)
    pool = [f"line number {chr(97 + k % 26) * (k % 7 + 1)} of the publishing house {chr(97 + k // 26)}" for k in range(60)]
    rows = []
    for i in range(400):
        source = "hot" if i % 3 == 0 else f"s{i % 11}"
        text = "\n".join(rng.choice(pool) if rng.random() < 0.6 else "".join(rng.choices("abcdefgh ", k=40)) for _ in range(rng.randrange(12)))
        rows.append((i, text.upper() if i % 5 == 0 else text, source, "x", "y"))
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows, depth=2) == brute(rows)
    assert found(spark, rows, min_docs=30) == brute(rows, 30)


def test_one_line_in_every_document_crosses_shards(spark):
    rows = [(i, "the same legal notice on every page\nshort", "one", None, None) for i in range(300)]
    assert found(spark, rows) == {(i, 1) for i in range(300)}
    assert found(spark, rows[:7]) == set()
    assert found(spark, rows[:8]) == {(i, 1) for i in range(8)}


def test_blocks_report_their_length(spark):
    block = "first line of the legal notice here\nsecond line of the legal notice here\nthird line of the legal notice here"
    rows = [(i, f"own text of document number {chr(97 + i) * 5}\n{block}", "s", None, None) for i in range(9)]
    got = {tuple(r) for r in rl.repeated_blocks(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {(n, k) for i, n, k in got if i == 0} >= {(2, 3), (3, 2), (4, 1)}


def test_nulls_empty_repeats_and_long(spark):
    line = "Share this notice with your colleagues now"
    rows = [(1, None, "s", None, None), (2, "", "s", None, None), (3, line, None, None, None), (None, line, "s", None, None)]
    rows += [(4, line, "s", None, None)] * 20
    assert found(spark, rows) == set()
    assert found(spark, []) == set()
    long = [(i, (line + "\n") * 3000, "s", None, None) for i in range(8)]
    assert len(found(spark, long)) == 8 * 3000


def test_clean_text(spark):
    line = "Terms of use and privacy of the portal"
    rows = [(i, f"own words {i}\r\n{line}\n\nmore", "s", None, None) for i in range(8)] + [(9, None, "s", None, None), (10, "alone\n", "t", None, None)]
    got = {r[0]: r[1:] for r in rl.without_repeated_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[3] == ("own words 3\r\n\nmore", 1) and got[9] == (None, 0) and got[10] == ("alone\n", 0)
    assert not re.search("privacy", got[0][0])
