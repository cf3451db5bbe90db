import random

from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.llm import splitting as sp


def check(text, size=800, overlap=120):
    got = sp.pieces(text, size, overlap)
    assert (got == []) == (text == "")
    if got:
        assert got[0][0] == 0 and got[-1][1] == len(text)
    for a, b in got:
        assert 0 < b - a <= size
    for (a, b), (c, d) in zip(got, got[1:]):
        assert a < c <= b < d and b - c <= overlap
        if overlap:
            # the overlap ends short only where no word begins in reach
            begins = [k for k in range(b - overlap, b) if 0 < k < len(text) and text[k - 1].isspace() and not text[k].isspace()]
            assert b - c == overlap or any(c <= k for k in begins) and not any(k < c and sp.strengths(text)[k] for k in range(b - overlap, c))
    return got


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n,;|1Se", max_size=3000))
def test_no_text_is_lost(text):
    check(text)
    check(text, 50, 10)
    check(text, 50, 0)


def test_lengths_around_the_limit():
    assert [len(check("x" * n)) for n in (799, 800, 801)] == [1, 1, 2]
    assert check("x" * 2000) == [(0, 800), (680, 1480), (1360, 2000)]


def test_cuts_at_the_strongest_boundary():
    body = "word " * 120
    text = body + "\n\nSection 12. On mats. " + body
    a, b = check(text)[0]
    assert text[b:].startswith("Section 12.")
    text = "a b. " * 300
    assert all(text[b - 2] == "." for _, b in check(text)[:-1])


def test_long_text_over_several_blocks():
    rng = random.Random(1)
    text = "".join(rng.choices("abcdefg .\n", k=400_000))
    got = sp.pieces(text)
    # the same cuts as with one table over the whole text
    old, sp.BLOCK = sp.BLOCK, 1 << 20
    try:
        assert sp.pieces(text) == got
    finally:
        sp.BLOCK = old


def test_table(spark):
    schema = "chunk_id string, text string, id string, start bigint"
    rows = [("a", "x" * 801, "z", 1), ("a", "x" * 801, "q", 2), ("b", "", None, None), ("c", None, None, None), (None, "y", None, None), ("d", "short", None, 0)]
    got = sorted(tuple(r) for r in sp.split_items(spark.createDataFrame(rows, schema), "chunk_id", "text").collect())
    assert [(r[0], r[1]) for r in got] == [("a", 0), ("a", 1), ("d", 0)]
    assert sp.split_items(spark.createDataFrame([], schema), "chunk_id", "text").count() == 0


def test_pieces_of_oversized_chunks(spark):
    import __spark_entry__ as entry

    root = "/root/testdata/sf0.001"
    chunks = spark.read.parquet(f"{root}/chunks.parquet").where("length(text) > 800").select("chunk_id", "text").distinct().collect()
    got = {}
    for r in entry.queries()["p7_chunk_pieces"](spark, root).orderBy("chunk_id", "chunk_index").collect():
        got.setdefault(r["chunk_id"], []).append(r)
    assert chunks and set(got) == {c["chunk_id"] for c in chunks}
    for chunk_id, text in chunks:
        whole = ""
        for k, r in enumerate(got[chunk_id]):
            assert r["chunk_index"] == k and len(r["text"]) <= 800 and len(whole) - 120 <= r["start"] <= len(whole)
            whole = whole[:r["start"]] + r["text"]
        assert len(got[chunk_id]) > 1 and whole == text
