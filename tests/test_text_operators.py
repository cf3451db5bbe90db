import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import chunk, clean, extract


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column.alias("x")).first()["x"]


def cleaned(spark, value, *names):
    return one(spark, value, clean.clean(F.col("t"), *names))


def test_cleaning_steps(spark):
    cases = [
        ("a\r\nb", ("carriage_return",), "a\n\nb"), ("text 2[note]", ("footnote_marker",), "text [note]"), ("a\n4* * *\nb", ("omission_stars",), "a\n\nb"),
        ("a\n 12 \nb", ("number_line",), "a\n\nb"), ("a\nPage 3\nb", ("page_line",), "a\n\nb"), ("a-----b", ("separator",), "ab"), ("a----b", ("separator",), "a----b"),
        ("x *Subject to verification of all\ny", ("boilerplate",), "x \ny"), ("one\ntwo", ("soft_newline",), "one two"), ("one\n\ntwo", ("soft_newline",), "one\n\ntwo"),
        ("one\n[PAGE 2]\ntwo", ("soft_newline",), "one\n[PAGE 2] two"), ("one\na | b\ntwo", ("soft_newline",), "one\na | b two"),
        ("1. Subs. by Act 3\nkept", ("amendment_note",), "kept"), ("2. 3rd May notes\nkept", ("dated_note",), "kept"), ("a\n\n\n\nb", ("blank_lines",), "a\n\nb"),
        ("a \t b", ("blanks",), "a b"), ("  à b ", ("blanks",), "à b"),
        # white space and digits of Unicode
        ("a\n\u00a012\u00a0\nb", ("number_line",), "a\n\nb"), ("a\n\u00a0Page\u00a03\nb", ("page_line",), "a\n\nb"), ("a\n१२\nb", ("number_line",), "a\n\nb"),
        ("a\n*\u00a0*\u00a0*\nb", ("omission_stars",), "a\n\nb"), ("1.\u00a0Subs. by Act 3\nkept", ("amendment_note",), "kept"), ("é12[x", ("footnote_marker",), "é12[x"),
        ("a\n\u00a0\n\u00a0\nb", ("blank_lines",), "a\n\nb"),
    ]
    for raw, names, want in cases:
        got = cleaned(spark, raw, *names)
        assert got == want.strip() or got == want, (raw, names, got)
    assert cleaned(spark, None) is None


def python_repeated(text):
    """The rule said again in plain Python."""
    pages = [[x.strip() for x in p.splitlines() if x.strip()] for p in re.split(r"\[PAGE\s+\d+\]", text)]
    need = max(3, min(int(0.4 * len(pages)), 15))
    gone = {x for p in pages for x in p if 5 < len(x) < 80 and sum(x in q for q in pages) >= need}
    return "\n".join("\n".join([f"[PAGE {k}]", *(x for x in p if x not in gone)]) for k, p in enumerate(pages, 1)), gone


def test_repeated_lines(spark):
    rng = random.Random(1)
    rows = []
    for i, pages in enumerate([0, 1, 2, 3, 8, 40, 60]):
        heads = ["short", "header", "h" * 79, "h" * 80]
        rows.append((i, "".join(f"[PAGE\u00a0{n}]\n" + rng.choice(["", "a\u2028b\x0bheader\n"]) + "\n".join(rng.choice(heads + [f"own {n} {k}"] * 3) for k in range(6)) + "\n" for n in range(1, pages + 1))))
    df = spark.createDataFrame(rows, "id int, t string")
    kept = dict(tuple(r) for r in clean.without_repeated_lines(df, "id", "t").collect())
    lines = {}
    for r in clean.repeated_lines(df, "id", "t").collect():
        lines.setdefault(r["id"], set()).add(r["line"])
    for i, text in rows:
        want, gone = python_repeated(text)
        assert kept[i] == want, (kept[i], want)
        assert lines.get(i, set()) == gone


def test_fixed_page_numbers(spark):
    df = spark.createDataFrame([(1, "top\n[PAGE 2]\na\n[PAGE 5]\nb")], "id int, t string")
    assert clean.without_repeated_lines(df, "id", "t", fix_page_numbers=True).first()["text"] == "top\n[PAGE 2]\na\n[PAGE 5]\nb"
    assert clean.without_repeated_lines(df, "id", "t").first()["text"] == "[PAGE 1]\ntop\n[PAGE 2]\na\n[PAGE 3]\nb"


def test_fields(spark):
    text = "CHAPTER XII\nsubsection 5 and Section 12A of the Customs Act, Notification No. 5/2020-Cus in 2019 on 8471.30.10"
    df = spark.createDataFrame([(text,), ("nothing here",), (None,)], "t string")
    a, b, c = df.select(*(x.alias(k) for k, x in extract.document_fields(F.col("t")).items())).collect()
    assert tuple(a) == ("XII", "12A", "5/2020-Cus", "2020", "12A") and set(b) == set(c) == {None}
    a = df.select(*(x.alias(k) for k, x in extract.chunk_fields(F.col("t")).items())).first()
    assert tuple(a) == ("5", None, "5/2020-Cus", "8471.30.10")
    assert one(spark, "x [PAGE 12] y [PAGE 13]", extract.page_number(F.col("t"))) == 12
    wide = "Chapter\u00a0IV Section\u00a05 of\u2003the\u00a0Customs Act, Notification\u00a0No.\u00a07/2021, é2019 2020é 2021"
    a = spark.createDataFrame([(wide,)], "t string").select(*(x.alias(k) for k, x in extract.document_fields(F.col("t")).items())).first()
    assert tuple(a) == ("IV", "5", "7/2021", "2021", "5")


def test_enrich_overwrites_with_null(spark):
    df = spark.createDataFrame([("Section 5", "x", "y")], "t string, section string, chapter string")
    assert extract.enrich(df, "t").select("section", "chapter").first() == ("5", None)


def test_merge_metadata(spark):
    got = spark.range(1).select(extract.merge_metadata(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("a"), F.lit("3"))).alias("m")).first()["m"]
    assert got == {"a": "3", "b": "2"}


def test_sections(spark):
    got = one(spark, "intro\nSection 1\ntext\n2. more\nProvided that x\nno boundary", chunk.sections(F.col("t")))
    assert got == ["intro", "Section 1\ntext", "2. more", "Provided that x\nno boundary"]
    assert one(spark, "a\nSection\n12. b", chunk.sections(F.col("t"))) == ["a", "Section\n12. b"]
    assert one(spark, "a\nProvided\u00a0that b\nSECTION\u00a04 c", chunk.sections(F.col("t"))) == ["a", "Provided\u00a0that b", "SECTION\u00a04 c"]


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab .\nRule ", max_size=2500))
def test_recursive_split_keeps_the_limit_and_all_words(text):
    got = chunk.recursive_split(text, 200, 30)
    assert all(0 < len(p) <= 200 and p == p.strip() for p in got)
    assert set("".join(text.split())) == set("".join("".join(got).split()))


def test_recursive_split_special_cases():
    assert [len(p) for p in chunk.recursive_split("x" * 2161)] == [800, 800, 800, 121]
    assert chunk.recursive_split("") == [] and chunk.recursive_split("a" * 799) == ["a" * 799]


def test_pages_and_short_chunks(spark):
    rows = [(1, 0, "x" * 50), (1, 1, "[PAGE 2] " + "y" * 120), (1, 2, "s1"), (1, 3, "s2"), (1, 4, "z" * 120), (2, 0, "short")]
    df = spark.createDataFrame(rows, "id int, chunk_index int, t string")
    paged = chunk.carry_page(df, "id", extract.page_number(F.col("t")))
    assert [r["page_number"] for r in paged.orderBy("id", "chunk_index").collect()] == [None, 2, 2, 2, 2, None]
    merged = chunk.merge_short(paged, "id", "t").orderBy("id", "chunk_index").collect()
    assert [(r["chunk_index"], r["t"][-5:]) for r in merged] == [(1, "s1 s2"), (4, "zzzzz")]


def test_chunk_documents(spark):
    df = spark.createDataFrame([(1, "[PAGE 1]\n" + "The duty is owed. " * 100 + "\nSection 5 " + "More words follow. " * 60), (2, None), (3, "")], "id int, t string")
    got = chunk.chunk_documents(df, "id", "t").collect()
    assert {r["id"] for r in got} == {1} and all(120 <= len(r["text"]) for r in got) and len({r["chunk_id"] for r in got}) == len(got)
    assert any(r["section"] == "5" for r in got) and got[0]["page_number"] == 1


def test_tokens_and_queries(spark):
    assert one(spark, "Été n° 5/2020-Cus, a.b_c!", T.tokens(F.col("t"))) == ["été", "n", "5/2020-cus", "a.b_c"]
    assert one(spark, "  a \n b\t", T.normalise_query(F.col("t"))) == "a b"
    assert one(spark, "a b c", T.token_estimate(F.col("t"))) == 3
    assert one(spark, "A-b C", T.collection_name("x_", F.col("t"))) == "x_a_b_c"
    assert one(spark, "q", T.prefix_query(F.col("t"), "Nomic-x")) == "search_query: q"
    assert one(spark, "please IGNORE previous", T.matches_any(F.col("t"), ["ignore previous"])) is True
    assert one(spark, "ignore  previous", T.matches_any(F.col("t"), ["ignore previous"])) is False
