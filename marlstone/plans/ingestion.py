"""Queries on ingestion, layout and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import token_estimate
from ..operators import answer, index, ingest, layout
from ..plugins import hash_embedding
from ..runtime import cut, table
from .cleaning import DOC_FIELDS, PREPARED, _chain
from .common import found, strip, tokens
from .retrieval import INDEX


def dedup_ingest(spark: SparkSession, root: str) -> DataFrame:
    """Documents that the log has no completed record of, one per content."""
    docs = table(spark, root, "parsed_documents").select("parsed_id", "document_hash")
    done = table(spark, root, "ingest_log").where("status = 'completed'")
    return ingest.new_documents(docs, done, "parsed_id")


def _ingested(spark: SparkSession, root: str) -> ingest.Ingestion:
    """All parsed documents as one batch over an empty record, with the stand-in embedding."""
    none = spark.createDataFrame([], "document_hash string")
    return ingest.run(table(spark, root, "parsed_documents"), none, "parsed_id", lambda chunks: chunks.withColumn("embedding", hash_embedding(F.col("text"))))


def ingest_status(spark: SparkSession, root: str) -> DataFrame:
    """What became of each document, and what was found in the new ones."""
    made = _ingested(spark, root)
    fields = made.documents.select("parsed_id", "document_hash", "section", "chapter", "notification_number", "hs_code", "customs_section")
    return made.status.select("parsed_id", "status", "error", (F.col("chunk_count") > 0).alias("chunked")).join(fields, "parsed_id", "left")


def ingest_index(spark: SparkSession, root: str) -> DataFrame:
    """Document frequencies of an index that was built from the documents of one half of the sources and appended to by those of the other."""
    docs = table(spark, root, "documents").select("doc_id", "text", (F.coalesce("source", F.lit("")) < "m").alias("first"))
    built = index.build(docs.where("first"), "doc_id", "text")
    return index.append(built, docs, "doc_id", "text").terms.select("term", "df", F.round("idf", 6).alias("idf"))


def ingest_totals(spark: SparkSession, root: str) -> DataFrame:
    return ingest.totals(table(spark, root, "ingest_log").distinct())


def records_desc(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "ingest_log").distinct()
    return rows.select("doc_id", "status", ingest.ingested_order(F.col("ingested_at")).alias("at")).orderBy(F.desc("at"), "doc_id", "status")


def batch_assignment(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "chunks").select("doc_type", "chunk_id").distinct()
    return ingest.batches(rows, "doc_type", "chunk_id").groupBy("doc_type", "batch").agg(F.count("*").alias("rows"))


def sentinel_codec(spark: SparkSession, root: str) -> DataFrame:
    """Metadata as a scalar store holds it."""
    rows = table(spark, root, "chunks").select("chunk_id", "page_number", "reference_number", "section", "tags").distinct()
    return ingest.encode_sentinels(rows, ["page_number"], ["reference_number", "section"], ["tags"])


def sentinel_round_trip(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "chunks").select("chunk_id", "page_number", "section").distinct()
    return ingest.decode_sentinels(ingest.encode_sentinels(rows, ["page_number"], ["section"], []), ["page_number"], ["section"], [])


def table_block_antijoin(spark: SparkSession, root: str) -> DataFrame:
    """Boxes from lineitem: a page is a supplier and a ship month; lines returned are tables, the others blocks."""
    rows = table(spark, root, "lineitem").select(
        F.col("l_suppkey").alias("doc"), F.date_format("l_shipdate", "yyyyMM").alias("page"), F.col("l_orderkey").alias("line"), "l_returnflag",
        F.col("l_quantity").alias("x0"), (F.col("l_discount") * 100).alias("y0"), (F.col("l_quantity") + F.col("l_linenumber")).alias("x1"),
        (F.col("l_discount") * 100 + F.col("l_linenumber")).alias("y1"))
    wide = rows.where("l_returnflag = 'R'").select("doc", "page", "x0", "y0", (F.col("x1") + 20).alias("x1"), (F.col("y1") + 5).alias("y1"))
    kept = layout.outside_tables(rows.where("l_returnflag <> 'R'"), wide, ["doc", "page"])
    return kept.groupBy("doc").agg(F.count("*").alias("blocks"), F.round(F.sum("x0"), 2).alias("left"))


def reading_order(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "events").select(F.col("user_id").alias("doc"), "event_id", F.col("value").alias("y0"), (F.col("value") * 7 % 100).alias("x0"))
    return layout.reading_order(rows, ["doc"], "event_id").select("doc", "event_id", "position")


def render_rows(spark: SparkSession, root: str) -> DataFrame:
    cells = F.array("p_name", F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_brand")), F.when(F.col("p_size") % 5 != 0, F.col("p_type")))
    return table(spark, root, "part").select("p_partkey", *(layout.row_text(cells, k).alias(k) for k in ("all", "filled", "not_null")))


def _sources(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "advisories").select("session_id", "source_references").dropDuplicates(["session_id"])
    return rows.select(F.col("session_id").alias("query_id"), F.posexplode("source_references").alias("p", "r")).select(
        "query_id", (F.col("p") + 1).alias("rank"), "r.doc_id", "r.source_name", "r.reference_number", "r.page_number", "r.chunk_text")


def build_context(spark: SparkSession, root: str) -> DataFrame:
    return answer.context(_sources(spark, root)).select("query_id", "context")


def source_list(spark: SparkSession, root: str) -> DataFrame:
    return answer.context(_sources(spark, root)).select("query_id", "source_list")


def prompts(spark: SparkSession, root: str) -> DataFrame:
    asked = table(spark, root, "advisories").select(F.col("session_id").alias("query_id"), "query").dropDuplicates(["query_id"])
    rows = asked.join(answer.context(_sources(spark, root)), "query_id")
    return rows.select("query_id", answer.prompt(F.col("query"), F.col("source_list"), F.col("context")).alias("prompt"))


def _responses(spark: SparkSession, root: str) -> DataFrame:
    """Advisories written as a model would: JSON, fenced JSON, sections or plain text, by the length of the query."""
    rows = table(spark, root, "advisories").select("session_id", "query", "short_answer", "reasoning", "classification").dropDuplicates(["session_id"])
    a, r = F.coalesce("short_answer", F.lit("")), F.coalesce("reasoning", F.lit(""))
    made = F.to_json(F.struct(a.alias("short_answer"), "classification", r.alias("reasoning"), F.lit("Penalty").alias("risk_flags")))
    sections = F.concat(F.lit("SHORT_ANSWER: "), a, F.lit("\nREASONING:\n"), r, F.lit("\nRISK_FLAGS:\n- delay\n* fine\n\nCONFIDENCE_NOTE: none"))
    kind = F.length("query") % 4
    return rows.select("session_id", a.alias("a"), r.alias("r"), kind.alias("kind"), F.when(kind == 0, made).when(
        kind == 1, F.concat(F.lit("```json\n"), made, F.lit("\n```"))).when(kind == 2, sections).otherwise(F.concat(F.lit("> "), a)).alias("raw"))


def parse_response(spark: SparkSession, root: str) -> DataFrame:
    rows = answer.parse_responses(_responses(spark, root))
    return rows.select("session_id", "layer", "parsed.short_answer", "parsed.reasoning", "parsed.classification",
                       F.array_join("parsed.risk_flags", ";").alias("flags"))


def parse_sections(spark: SparkSession, root: str) -> DataFrame:
    rows = _responses(spark, root).where("kind = 2").select("session_id", answer.sections_layer(F.col("raw")).alias("s"))
    return rows.select("session_id", "s.short_answer", "s.reasoning", F.array_join("s.risk_flags", ";").alias("flags"), "s.confidence_note")


def extract_claims(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "advisories").select("session_id", "reasoning").dropDuplicates(["session_id"])
    return rows.select("session_id", F.posexplode(answer.claims(F.col("reasoning"))).alias("n", "claim"))


def _supported(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "advisories").select(
        "session_id", "reasoning", "confidence_score", F.transform("source_references", lambda r: r["chunk_text"]).alias("texts")).dropDuplicates(["session_id"])
    return rows.withColumn("reasoning", F.coalesce("reasoning", F.lit("")))


def claim_support(spark: SparkSession, root: str) -> DataFrame:
    return answer.claim_support(_supported(spark, root), "session_id", "reasoning", "texts")


def answer_confidence(spark: SparkSession, root: str) -> DataFrame:
    """Evidence by the stand-in scorer over all texts of a session together."""
    rows = _supported(spark, root)
    support = answer.claim_support(rows, "session_id", "reasoning", "texts").select("session_id", "support")
    joined = rows.join(support, "session_id")
    evidence = answer.overlap_score(F.col("reasoning"), F.array_join("texts", " "))
    return joined.select("session_id", answer.answer_confidence(evidence, F.col("support"), F.col("confidence_score"), F.size("texts")).alias("answer_confidence"))


def ingest_end_to_end(spark: SparkSession, root: str) -> DataFrame:
    """The chunks of the new documents, cleaned, with what was found in them and their embedding's first and last value."""
    rows = _ingested(spark, root).chunks
    return rows.select(*(c for c in rows.columns if c != "embedding"), F.round(F.element_at("embedding", 1), 6).alias("first"),
                       F.round(F.element_at("embedding", -1), 6).alias("last"))


QUERIES = {f.__name__: f for f in (
    dedup_ingest, ingest_status, ingest_index, ingest_totals, records_desc, batch_assignment, sentinel_codec, sentinel_round_trip, table_block_antijoin, reading_order, render_rows,
    build_context, source_list, prompts, parse_response, parse_sections, extract_claims, claim_support, answer_confidence, ingest_end_to_end)}

ONE = "(select distinct on (session_id) * from advisories)"
REFS = f"""re as (select session_id query_id, rank, r.doc_id doc_id, r.source_name source_name, r.reference_number ref, r.page_number page, r.chunk_text chunk_text from (
    select session_id, unnest(source_references) r, unnest(generate_series(1, len(source_references))) rank from {ONE})),
    cx as (select query_id, string_agg('[SOURCE ' || rank || '] ' || source_name || case when coalesce(ref, '') <> '' then ' | Ref: ' || ref else '' end
        || case when coalesce(page, 0) <> 0 then ' | Page: ' || page else '' end || chr(10) || chunk_text, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by rank) context
        from re group by query_id),
    sl as (select query_id, string_agg('- ' || name, chr(10) order by first) source_list from (
        select query_id, doc_id, arg_max(source_name, rank) name, min(rank) first from re group by all) group by query_id)"""
RESPONSES = f"""rs as (select session_id, coalesce(short_answer, '') a, coalesce(reasoning, '') r, classification c, length(query) % 4 kind from {ONE})"""
CLAIMS = """list_filter(list_transform(string_split_regex(r, '[.!?\\n]'), lambda x: """ + strip("x") + """), lambda x: length(x) > 15)"""
SUPPORT_STEPS = f"""cm as (select session_id, unnest({CLAIMS}) claim, texts from ad),
    ct as (select session_id, claim, list_distinct({tokens('claim')}) t, texts from cm),
    tt as (select session_id, claim, t, unnest(texts) x from ct),
    cs as (select session_id, claim, t, case when len(t) = 0 then 0 else round(len(list_intersect(t, list_distinct({tokens('x')}))) / len(t), 6) end s from tt),
    bs as (select session_id, claim, max(s) best from cs group by all),
    cc as (select session_id, count(*) n, count(*) filter (coalesce(best, 0) >= 0.7) k from (select cm.session_id, cm.claim, best from cm left join bs using (session_id, claim)) group by 1),
    su as (select session_id, coalesce(n, 0) n_claims, coalesce(k, 0) supported, case when coalesce(n, 0) = 0 then 0.5 else round(k / n, 6) end support
        from ad left join cc using (session_id)),
    ev as (select ad.session_id, support, confidence_score, len(texts) n, list_distinct({tokens('r')}) t, list_distinct({tokens("array_to_string(texts, ' ')")}) x from ad join su using (session_id)),
    co as (select session_id, round(greatest(0, least(1, round(0.4::double * case when len(t) = 0 then 0 else round(len(list_intersect(t, x)) / len(t), 6) end + 0.3::double * support
        + 0.2::double * confidence_score + 0.1::double * least(n / 5, 1) - case when support > 0.8 then 0 else 0.2::double end, 9))), 3) answer_confidence from ev)"""
SUPPORT = f"""ad as (select session_id, coalesce(reasoning, '') r, confidence_score, list_transform(source_references, lambda x: x.chunk_text) texts from {ONE}), {SUPPORT_STEPS}"""
SQL = {
    "dedup_ingest": """select min(parsed_id) parsed_id, document_hash from parsed_documents where document_hash not in (
        select document_hash from ingest_log where status = 'completed' and document_hash is not null) group by document_hash""",
    "ingest_totals": """select status, count(*) attempts, coalesce(sum(chunk_count), 0)::bigint chunks from (select distinct * from ingest_log) group by status""",
    "records_desc": """select doc_id, status, regexp_replace(ingested_at, 'Z$', '')::timestamp as at from (select distinct * from ingest_log)""",
    "batch_assignment": """select doc_type, batch, count(*) as rows from (select doc_type, ceil(row_number() over (partition by doc_type order by chunk_id) / 32.0)::int batch
        from (select distinct doc_type, chunk_id from chunks)) group by all""",
    "sentinel_codec": """select distinct chunk_id, coalesce(page_number, -1) page_number, coalesce(reference_number, '') reference_number, coalesce(section, '') as section,
        coalesce(to_json(tags)::varchar, '[]') tags from chunks""",
    "sentinel_round_trip": "select distinct chunk_id, page_number, section from chunks",
    "table_block_antijoin": """with r as (select l_suppkey doc, strftime(l_shipdate, '%Y%m') page, l_orderkey line, l_returnflag f, l_quantity x0, l_discount * 100 y0,
            l_quantity + l_linenumber x1, l_discount * 100 + l_linenumber y1 from lineitem),
        t as (select doc, page, x0, y0, x1 + 20 x1, y1 + 5 y1 from r where f = 'R')
        select doc, count(*) blocks, round(sum(x0), 2) as left from r b where f <> 'R' and not exists (select 1 from t where t.doc = b.doc and t.page = b.page
            and b.x0 >= t.x0 - 2 and b.y0 >= t.y0 - 2 and b.x1 <= t.x1 + 2 and b.y1 <= t.y1 + 2) group by doc""",
    "reading_order": """select user_id doc, event_id, row_number() over (partition by user_id order by round_even(value, 0), round_even(value * 7 % 100, 0), event_id)::int position
        from events""",
    "render_rows": """with c as (select p_partkey, p_name a, case when p_size % 3 = 0 then '' else p_brand end b, case when p_size % 5 <> 0 then p_type end c from part)
        select p_partkey, a || ' | ' || b || ' | ' || coalesce(c, '') as all, array_to_string(list_filter([a, b, c], lambda x: trim(coalesce(x, '')) <> ''), ' | ') filled,
        array_to_string(list_filter([a, b, c], lambda x: x is not null), ' | ') not_null from c""",
    "build_context": f"with {REFS} select query_id, context from cx",
    "source_list": f"with {REFS} select query_id, source_list from sl",
    "prompts": f"""with {REFS} select query_id, 'Answer from the sources below and name them; say so where they don''t hold the answer.' || chr(10) || chr(10) || 'Question: ' || query || chr(10) || chr(10) || 'Sources:' || chr(10)
        || source_list || chr(10) || chr(10) || 'Context:' || chr(10) || context || chr(10) || chr(10) || 'Reply with one JSON object and nothing else. Its keys: short_answer, '
        || 'classification (null if none), reasoning, alternate_views (null if none), risk_flags (a list), confidence_note.' prompt from cx join sl using (query_id)
        join (select distinct on (session_id) session_id query_id, query from advisories) using (query_id)""",
    "parse_response": f"""with {RESPONSES} select session_id, case kind when 2 then 'sections' when 3 then 'raw' else 'json' end layer,
        case kind when 2 then {strip('a')} when 3 then substring('> ' || a, 1, 500) else a end short_answer,
        case kind when 2 then {strip('r')} when 3 then '> ' || a else r end reasoning, case when kind < 2 then c end classification,
        case kind when 2 then 'delay;fine' when 3 then 'llm_response_parse_failed' else 'Penalty' end flags from rs""",
    "parse_sections": f"""with {RESPONSES} select session_id, {strip('a')} short_answer, {strip('r')} reasoning, 'delay;fine' flags, 'none' confidence_note from rs where kind = 2""",
    "extract_claims": f"""with ad as (select session_id, coalesce(reasoning, '') r from {ONE}), c as (select session_id, {CLAIMS} c from ad)
        select session_id, (unnest(generate_series(1, len(c))) - 1)::int n, unnest(c) claim from c""",
    "claim_support": f"with {SUPPORT} select * from su",
    "answer_confidence": f"with {SUPPORT} select * from co",
    "ingest_status": f"""with {PREPARED}, h as (select parsed_id, sha256(text) document_hash, text, parsed_id = min(parsed_id) over (partition by text) is_new from prepared)
        select d.parsed_id, case when d.raw_text is null then 'failed' else 'completed' end status,
            case when d.raw_text is null then 'No text' when not is_new then 'Duplicate document' end error,
            is_new is not null and is_new and length({_chain("text", (r"[[]PAGE [0-9]+[]]", "''"), (r"[[]SHEET:[^]]+[]]", "''"), (r"[ \t]{2,}", "' '"))}) >= 120 chunked,
            case when is_new then h.document_hash end document_hash, {", ".join(f"case when is_new then {found('text', p)} end {k}" for k, p in DOC_FIELDS.items())}
        from parsed_documents d left join h using (parsed_id)""",
    "ingest_index": f"with {INDEX} select term, df, round(idf, 6) idf from te",
}
