"""Queries on text: cleaning, fields, sections, chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SETTINGS
from ..functions import text as T
from ..operators import chunk, clean, extract
from ..operators.advise import UNSAFE
from ..runtime import table
from .common import SP, W, found, strip, sub

PLAIN_STEPS = ("carriage_return", "footnote_marker", "omission_stars", "number_line", "page_line", "separator", "boilerplate", "blank_lines", "blanks")


def _docs(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "parsed_documents")


def clean_steps(spark: SparkSession, root: str) -> DataFrame:
    return _docs(spark, root).select("parsed_id", clean.clean(F.col("raw_text"), *PLAIN_STEPS).alias("clean_text"))


def soft_newline_join(spark: SparkSession, root: str) -> DataFrame:
    return _docs(spark, root).select("parsed_id", clean.clean(F.col("raw_text"), "carriage_return", "soft_newline").alias("joined"))


def amendment_footnotes(spark: SparkSession, root: str) -> DataFrame:
    return _docs(spark, root).select("parsed_id", clean.clean(F.col("raw_text"), "amendment_note", "dated_note").alias("clean_text"))


def clean_full(spark: SparkSession, root: str) -> DataFrame:
    return _docs(spark, root).select("parsed_id", clean.clean(F.col("raw_text")).alias("clean_text"))


def strip_tags(spark: SparkSession, root: str) -> DataFrame:
    return _docs(spark, root).select("parsed_id", clean.strip_tags(F.col("raw_text")).alias("clean_text"))


def repeated_lines(spark: SparkSession, root: str) -> DataFrame:
    return clean.repeated_lines(_docs(spark, root), "parsed_id", "raw_text")


def strip_repeated(spark: SparkSession, root: str) -> DataFrame:
    return clean.without_repeated_lines(_docs(spark, root), "parsed_id", "raw_text")


def extract_doc_meta(spark: SparkSession, root: str) -> DataFrame:
    fields = extract.document_fields(F.col("raw_text"))
    return _docs(spark, root).select("parsed_id", *(c.alias(k) for k, c in fields.items()))


def extract_chunk_meta(spark: SparkSession, root: str) -> DataFrame:
    fields = extract.chunk_fields(F.col("text"))
    return (table(spark, root, "chunks").select("chunk_id", "text").distinct()
            .select("chunk_id", *(c.alias(k) for k, c in fields.items()), extract.page_number(F.col("text")).alias("page_number")))


def enrich_metadata(spark: SparkSession, root: str) -> DataFrame:
    found_ = extract.enrich(_docs(spark, root), "raw_text")
    return found_.select("parsed_id", *(k for k, _, _ in extract.DOCUMENT_FIELDS))


def quality_report(spark: SparkSession, root: str) -> DataFrame:
    return _docs(spark, root).select("parsed_id", *(c.alias(k) for k, c in clean.quality(F.col("raw_text")).items()))


def fingerprint(spark: SparkSession, root: str) -> DataFrame:
    return _docs(spark, root).select("parsed_id", clean.fingerprint(F.col("raw_text")).alias("fingerprint"),
                                     (clean.fingerprint(F.col("raw_text")) == F.col("document_hash")).alias("as_recorded"))


def legal_sections(spark: SparkSession, root: str) -> DataFrame:
    return _docs(spark, root).select("parsed_id", F.posexplode(chunk.sections(F.col("raw_text"))).alias("section_no", "section"))


def chunk_recursive(spark: SparkSession, root: str) -> DataFrame:
    return chunk.raw_chunks(_docs(spark, root), "parsed_id", "raw_text")


def chunk_documents(spark: SparkSession, root: str) -> DataFrame:
    return chunk.chunk_documents(_docs(spark, root), "parsed_id", "raw_text")


def chunk_window_special(spark: SparkSession, root: str) -> DataFrame:
    """Text without a separator: the splitter is a window of 800 with a step of 680."""
    solid = _docs(spark, root).select("parsed_id", F.regexp_replace(F.col("raw_text"), r"[\s.]+", "").alias("t")).where("t <> ''")
    return chunk.raw_chunks(solid, "parsed_id", "t")


def token_estimate(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "chunks").select("chunk_id", "text").distinct()
    return rows.select("chunk_id", T.token_estimate(F.col("text")).alias("tokens"))


def _lines(spark: SparkSession, root: str) -> DataFrame:
    return _docs(spark, root).select("parsed_id", F.posexplode(F.split(F.col("raw_text"), "\n")).alias("n", "line"))


def page_fill_forward(spark: SparkSession, root: str) -> DataFrame:
    paged = chunk.carry_page(_lines(spark, root), "parsed_id", extract.page_number(F.col("line")), "n")
    return paged.select("parsed_id", "n", "page_number")


def merge_short_chunks(spark: SparkSession, root: str) -> DataFrame:
    return chunk.merge_short(_lines(spark, root), "parsed_id", "line", "n")


def normalise_query(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "advisories").select("session_id", "query").distinct()
    return rows.select("session_id", T.normalise_query(F.col("query")).alias("query"))


def prefix_query(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "eval_items")
    return rows.select("item_id", T.prefix_query(F.col("question"), "nomic-embed-text").alias("prefixed"),
                       T.prefix_query(F.col("question"), "all-minilm").alias("plain"))


def unsafe_query(spark: SparkSession, root: str) -> DataFrame:
    """The advisories' queries, and each with an unsafe phrase before it."""
    rows = table(spark, root, "advisories").select("session_id", "query").distinct()
    told = rows.select("session_id", "query").unionByName(rows.select("session_id", F.concat(F.lit("Please OVERRIDE this. "), "query").alias("query")))
    return told.groupBy("session_id").agg(F.count("*").alias("asked"), F.count_if(T.matches_any(F.col("query"), UNSAFE)).alias("unsafe"))


def collection_names(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "documents").select("source").distinct().where("source is not null")
    return rows.select("source", T.collection_name("docs_", F.col("source")).alias("collection"))


QUERIES = {f.__name__: f for f in (
    clean_steps, soft_newline_join, amendment_footnotes, clean_full, strip_tags, repeated_lines, strip_repeated, extract_doc_meta, extract_chunk_meta,
    enrich_metadata, quality_report, fingerprint, legal_sections, chunk_recursive, chunk_documents, chunk_window_special, token_estimate,
    page_fill_forward, merge_short_chunks, normalise_query, prefix_query, unsafe_query, collection_names)}


def _steps(c: str, *steps: tuple[str, str]) -> str:
    for pattern, new in steps:
        c = sub(c, pattern, new)
    return c


def _chain(c: str, *steps: tuple[str, str]) -> str:
    return strip(_steps(c, *steps))


CR = (r"\r", "chr(10)")
EARLY = (CR, (r"\b\p{Nd}{1,2}\[", "'['"), (rf"(?m)^\p{{Nd}}*{SP}*\*({SP}|\*)*$", "''"), (rf"(?m)^{SP}*\p{{Nd}}+{SP}*$", "''"),
         (rf"(?im)^{SP}*Page{SP}+\p{{Nd}}+{SP}*$", "''"), (r"[_\-]{5,}", "''"), (r"(?i)\*Subject to verification.*", "''"))
NOTES = ((rf"(?im)^\p{{Nd}}+\.{SP}+(Subs\.|Ins\.|Omitted|Inserted|Added|Renumbered).*$", "''"),
         (rf"(?im)^\p{{Nd}}+\.{SP}+\p{{Nd}}{{1,2}}(st|nd|rd|th){SP}+[{W}]+.*$", "''"))
LATE = ((rf"\n{SP}*\n{SP}*\n+", "chr(10) || chr(10)"), (r"[ \t]+", "' '"))


def _joined(text: str, table_: str = "parsed_documents") -> str:
    """Without lookaround: a line is joined to the one before unless one of both is empty, it begins with [PAGE, or it has a bar."""
    return f"""l as (select parsed_id, unnest(generate_series(1, len(x))) n, unnest(x) line from (
        select parsed_id, string_split({text}, chr(10)) x from {table_})),
    j as (select *, lag(line) over (partition by parsed_id order by n) before from l),
    s as (select parsed_id, n, case when n = 1 then '' when before = '' or line = '' or starts_with(line, '[PAGE') or contains(line, '|')
        then chr(10) else ' ' end || line piece from j),
    jo as (select parsed_id, string_agg(piece, '' order by n) joined from s group by parsed_id)"""


LINE_END = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"


def _lines_sql(text: str = "raw_text", table_: str = "parsed_documents") -> str:
    return f"""lines as (select parsed_id, pages, page, unnest(generate_series(1, len(l))) line_no, unnest(l) raw from (
        select parsed_id, len(p) pages, unnest(generate_series(1, len(p))) page, string_split_regex(unnest(p), '{LINE_END}') l from (
            select parsed_id, string_split_regex({text}, '\\[PAGE{SP}+\\p{{Nd}}+\\]') p from {table_}))),
    stripped as (select parsed_id, pages, page, line_no, {strip("raw")} line from lines),
    repeated as (select parsed_id, line, count(distinct page) on_pages from stripped where length(line) between 6 and 79
        group by parsed_id, line having count(distinct page) >= greatest(3, least(floor(any_value(pages) * 0.4::double)::int, 15))),
    kept as (select s.*, r.line is null and s.line <> '' keep from stripped s left join repeated r on s.parsed_id = r.parsed_id and s.line = r.line),
    pages as (select parsed_id, page, '[PAGE ' || page || ']' || coalesce(chr(10) || string_agg(line, chr(10) order by line_no) filter (keep), '') page_text from kept group by parsed_id, page),
    rewritten as (select parsed_id, string_agg(page_text, chr(10) order by page) as text from pages group by parsed_id)"""


BOUNDARY_SQL = (rf"(?i)(\n(?:\p{{Nd}}+[A-Z]?\.|Section{SP}+\p{{Nd}}+[A-Z]?|CHAPTER{SP}+[IVXLC]+|PART{SP}+[IVXLC]+|Rule{SP}+\p{{Nd}}+"
                rf"|Explanation\.|Provided{SP}+that|Provided{SP}+further|Illustration))")
# word boundaries of Unicode words, without lookaround: the characters on either side are read as well
DOC_FIELDS = {
    "chapter": rf"(?i)CHAPTER{SP}+([IVXLC0-9]+)", "section": rf"(?i)(?:^|[^{W}])Section{SP}+(\p{{Nd}}+[A-Z]?)",
    "notification_number": rf"(?i)Notification{SP}+No\.?{SP}*([{W}/-]+)",
    "hs_code": rf"(?:^|[^{W}])(\p{{Nd}}{{4}}(?:\.\p{{Nd}}{{2}})?(?:\.\p{{Nd}}{{2}})?)(?:$|[^{W}])",
    "customs_section": rf"(?i)(?:^|[^{W}])Section{SP}+(\p{{Nd}}+[A-Z]?){SP}+of{SP}+the{SP}+Customs{SP}+Act",
}
CHUNK_FIELDS = {
    "section": rf"(?i)Section{SP}+(\p{{Nd}}+[A-Z]?)", "chapter": rf"(?i)CHAPTER{SP}+(\p{{Nd}}{{1,2}})",
    "notification": rf"(?i)Notification{SP}+No\.?{SP}*([{W}/-]+)",
    "hs_code": rf"(?:^|[^{W}])(\p{{Nd}}{{4}}\.\p{{Nd}}{{2}}(?:\.\p{{Nd}}{{2}})?)(?:$|[^{W}])", "page_number": r"\[PAGE (\p{Nd}+)\]",
}

# cleaned texts without their repeated lines: prepared(parsed_id, text)
PREPARED = f"""{_joined(_steps('raw_text', *EARLY))}, cl as (select parsed_id, {_chain('joined', *NOTES, *LATE)} clean_text from jo),
    {_lines_sql('clean_text', 'cl')}, prepared as (select parsed_id, text from rewritten)"""

SQL = {
    "clean_steps": f"select parsed_id, {_chain('raw_text', *EARLY, *LATE)} clean_text from parsed_documents",
    "clean_full": f"with {_joined(_steps('raw_text', *EARLY))} select parsed_id, {_chain('joined', *NOTES, *LATE)} clean_text from jo",
    "soft_newline_join": f"with {_joined(_steps('raw_text', CR))} select parsed_id, {strip('joined')} joined from jo",
    "amendment_footnotes": f"select parsed_id, {_chain('raw_text', *NOTES)} clean_text from parsed_documents",
    "strip_tags": "select parsed_id, " + _chain(
        "raw_text", (r"\[PAGE \p{Nd}+\]", "''"), (r"\[SHEET:[^\]]+\]", "''"), (r"\n{3,}", "chr(10) || chr(10)"), (r"[ \t]{2,}", "' '"))
        + " clean_text from parsed_documents",
    "repeated_lines": f"with {_lines_sql()} select parsed_id, line, on_pages from repeated",
    "strip_repeated": f"with {_lines_sql()} select parsed_id, text from rewritten",
    "extract_doc_meta": "select parsed_id, " + ", ".join(f"{found('raw_text', p)} {k}" for k, p in DOC_FIELDS.items()) + " from parsed_documents",
    "extract_chunk_meta": "select chunk_id, " + ", ".join(f"{found('text', p)}{'::int' if k == 'page_number' else ''} {k}" for k, p in CHUNK_FIELDS.items())
        + " from (select distinct chunk_id, text from chunks)",
    "enrich_metadata": "select parsed_id, " + ", ".join(f"{found('raw_text', p)} {k}" for k, p in DOC_FIELDS.items()) + " from parsed_documents",
    "quality_report": r"""select parsed_id, length(raw_text) chars, len(regexp_extract_all(raw_text, '\[PAGE')) page_tags,
        len(regexp_extract_all(raw_text, '\n\n')) blank_lines, regexp_matches(raw_text, '[^\p{L}\p{N}_\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}.,:;()%/\-\[\]]{15,}') ocr_noise
        from parsed_documents""",
    "fingerprint": "select parsed_id, sha256(raw_text) fingerprint, sha256(raw_text) = document_hash as_recorded from parsed_documents",
    "legal_sections": f"""with p as (select parsed_id, unnest(generate_series(1, len(x))) n, {strip("unnest(x)")} as section from (
            select parsed_id, string_split(regexp_replace(raw_text, '{BOUNDARY_SQL}', chr(1) || '\\1', 'g'), chr(1)) x from parsed_documents))
        select parsed_id, (row_number() over (partition by parsed_id order by n) - 1)::int section_no, section from p where section <> ''""",
    "chunk_window_special": f"""with s as (select parsed_id, regexp_replace(raw_text, '[\\s.]+', '', 'g') t from parsed_documents),
        w as (select parsed_id, t, unnest(generate_series(0, greatest(0, ceil((length(t) - 800) / 680.0)::int))) i from s where t <> '')
        select parsed_id, i::int chunk_index, {strip("substring(t, 680 * i::int + 1, 800)")} raw from w""",
    "token_estimate": f"""select chunk_id, floor(len(list_filter(string_split_regex(text, '{SP}+'), lambda t: t <> '')) * 1.3::double)::int tokens
        from (select distinct chunk_id, text from chunks)""",
    "page_fill_forward": r"""select parsed_id, (n - 1)::int n, last_value(nullif(regexp_extract(line, '\[PAGE (\d+)\]', 1), '')::int ignore nulls)
        over (partition by parsed_id order by n rows unbounded preceding) page_number from (
        select parsed_id, unnest(generate_series(1, len(x))) n, unnest(x) line from (
            select parsed_id, string_split(raw_text, chr(10)) x from parsed_documents))""",
    "merge_short_chunks": """with l as (select parsed_id, (unnest(generate_series(1, len(x))) - 1)::int n, unnest(x) line from (
            select parsed_id, string_split(raw_text, chr(10)) x from parsed_documents)),
        g as (select *, sum((length(line) >= 120)::int) over (partition by parsed_id order by n) k from l)
        select parsed_id, min(n)::int n, string_agg(line, ' ' order by n) line from g where k > 0 group by parsed_id, k""",
    "normalise_query": f"select session_id, {sub(strip('query'), SP + '+', chr(39) + ' ' + chr(39))} query from (select distinct session_id, query from advisories)",
    "prefix_query": "select item_id, 'search_query: ' || question prefixed, question plain from eval_items",
    "unsafe_query": """select session_id, count(*) asked, count(*) filter (regexp_matches(lower(query), 'ignore previous|system prompt|forget instructions|override')) unsafe
        from (select distinct session_id, query from advisories union all
              select distinct session_id, 'Please OVERRIDE this. ' || query from advisories) group by 1""",
    "collection_names": "select source, lower('docs_' || regexp_replace(source, '[^a-zA-Z0-9]', '_', 'g')) collection from (select distinct source from documents where source is not null)",
}
