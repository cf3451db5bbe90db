"""The pN_ queries over the tables of TESTDATA.md, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import cut, table
from . import answer_defects, format_copies, leaks, near_copies, neighbours, packing, repeated_lines, scan_repair, shared_spans, splitting


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return scan_repair.ScanRepair(table(spark, root, "parsed_documents")).damages()


def p1_repaired(spark: SparkSession, root: str) -> DataFrame:
    return scan_repair.ScanRepair(table(spark, root, "parsed_documents")).repaired()


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return answer_defects.find_defects(table(spark, root, "advisories"))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return repeated_lines.repeated_line_positions(table(spark, root, "parsed_documents"))


def p3_clean(spark: SparkSession, root: str) -> DataFrame:
    return repeated_lines.without_repeated_lines(table(spark, root, "parsed_documents"))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return format_copies.copy_pairs(table(spark, root, "parsed_documents"))


def p4_collapsed(spark: SparkSession, root: str) -> DataFrame:
    return format_copies.collapse(table(spark, root, "parsed_documents"))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    """Chunks that the splitter had to cut."""
    cuts = splitting.split_items(table(spark, root, "chunks"), "chunk_id", "text", 800, 120)
    return cuts.where("chunk_index = 1").select("chunk_id").distinct()


def p7_pieces(spark: SparkSession, root: str) -> DataFrame:
    return splitting.split_items(table(spark, root, "parsed_documents"), "parsed_id", "raw_text", 800, 120)


def p7_chunk_pieces(spark: SparkSession, root: str) -> DataFrame:
    """Pieces of the chunks that came out too long."""
    chunks = table(spark, root, "chunks").where(F.length("text") > 800)
    return splitting.split_items(chunks, "chunk_id", "text", 800, 120)


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return neighbours.nearest_pairs(table(spark, root, "vectors"), "chunk_id", "embedding", 64, 5)


def p5_search(spark: SparkSession, root: str) -> DataFrame:
    """Greedy graph search for the 5 nearest others of every vector whose id is divisible by 100."""
    rows = table(spark, root, "embeddings")
    graph = neighbours.Graph(rows, "vec_id", "embedding", 64)
    return graph.search(rows.where("vec_id % 100 = 0"), "vec_id", "embedding", 64, 5, others_only=True)


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return near_copies.near_pairs(table(spark, root, "chunks"), "chunk_id", "text", 3, 0.5)


def p6_groups(spark: SparkSession, root: str) -> DataFrame:
    return near_copies.near_groups(table(spark, root, "chunks"), "chunk_id", "text")


def p8_packing(spark: SparkSession, root: str) -> DataFrame:
    return packing.pack(packing.token_sizes(table(spark, root, "documents")))


def p8_containers(spark: SparkSession, root: str) -> DataFrame:
    return packing.containers(p8_packing(spark, root))


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    return p9_leaks(spark, root).select("doc_id", "item_id")


def p9_leaks(spark: SparkSession, root: str) -> DataFrame:
    """Each leak with how much of the passage and of the question the document holds."""
    return leaks.find_leaks(table(spark, root, "documents"), table(spark, root, "eval_items"))


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    return shared_spans.SharedSpans(table(spark, root, "documents")).pairs()


def p10_shared(spark: SparkSession, root: str) -> DataFrame:
    """Each text's shared spans, written as start-end;start-end, and their part of it."""
    rows = shared_spans.SharedSpans(table(spark, root, "documents")).coverage()
    span = F.transform("spans", lambda p: F.concat_ws("-", p["start"], p["end"]))
    return rows.withColumn("spans", F.array_join(span, ";"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_repaired, p2_found, p3_found, p3_clean, p4_found, p4_collapsed, p5_found, p5_search, p6_found, p6_groups, p7_found, p7_pieces, p7_chunk_pieces, p8_packing, p8_containers, p9_found, p9_leaks, p10_found, p10_shared)}


LINES = """lines as (select source_name, parsed_id, unnest(generate_series(1, len(l))) line_no, unnest(l) line from (
    select distinct source_name, parsed_id, string_split(raw_text, chr(10)) l from parsed_documents where raw_text is not null)),
keyed as (select source_name, parsed_id, line_no::int line_no, line, regexp_replace(lower(line), '[^\\p{L}]+', '', 'g') k from lines),
many as (select source_name, k from keyed where length(k) >= 20 group by all having count(distinct parsed_id) >= 8)"""


SP = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOT_SP, NOT_WORD = SP.replace("[", "[^", 1), r"[^\p{L}\p{N}_]"


def _pieces_sql(rows: str, key: str) -> str:
    """Splitting as a recursive query: strengths from the 64 characters before and the 48 behind each position."""
    ends = lambda p: f"regexp_matches(pre, '{p}$')"
    return f"""with recursive t as ({rows}),
    c as (select id, p, substring(text, greatest(1, p - 63), least(p, 64)) pre, substring(text, p + 1, 48) suf from (select *, unnest(generate_series(1, length(text) - 1)) p from t)),
    b as (select id, p, case
        when ends_with(pre, chr(10)) and regexp_matches(suf, '(?i)^(\\p{{Nd}}+[A-Z]?\\. |(Section|Rule|Article|Clause|CHAPTER|PART|SCHEDULE|ANNEXURE){SP}+[\\dIVXLC]|(Explanation|Provided (that|further)|Illustration)({NOT_WORD}|$))') then 9
        when regexp_matches(suf, '^\\[(PAGE|SHEET|ROW)({NOT_WORD}|$)') then 8
        when ends_with(pre, ' | ') then 4 when not regexp_matches(pre, '{SP}$') or regexp_matches(suf, '^{SP}') then 0
        when {ends(f"{chr(10)}{SP}*{chr(10)}{SP}*")} then 7 when regexp_matches(reverse(pre), '^[^{chr(10)}]*{chr(10)}') and regexp_matches(pre, '{chr(10)}{SP}*$') then 6
        when {ends(f'[.!?।]["”’)' + chr(39) * 2 + f'\\]]*{SP}+')} then 5 when {ends(f';{SP}+')} then 4 when {ends(f'[,:]{SP}+')} then 3 else 2 end s from c),
    k as (select id, max(p) + 1 n, list(case when s > 0 then s * 1000000000::bigint + p else 0 end order by p) k from b group by id
        union all select id, length(text), [] from t where length(text) = 1),
    r as (select id, 0 i, 0::bigint a, case when n <= 800 then n else coalesce(nullif(list_max(k[400:800]) % 1000000000, 0), 800) end z from k
        union all
        select id, i, a, case when n - a <= 800 then n else coalesce(nullif(list_max(k[a + 400:a + 800]) % 1000000000, 0), a + 800) end z
        from (select r.id, r.i + 1 i, n, k, coalesce(list_min(list_transform(list_filter(k[z - 120:z - 1], lambda x: x > 0), lambda x: x % 1000000000)), z - 120) a
            from r join k on k.id = r.id where z < n) q)
    select r.id {key}, i::int chunk_index, a::bigint start, substring(text, a::int + 1, (z - a)::int) as text from r join t on t.id = r.id"""


CONTENTS = f"""d as (select distinct parsed_id, raw_text from parsed_documents where raw_text is not null),
    l as (select parsed_id, n, line, regexp_matches(line, '(?i)^[^\\p{{L}}\\p{{N}}_\\[]*\\[{SP}*ROW{SP}+\\p{{Nd}}+{SP}*\\]') is_row,
        regexp_matches(line, '^[^\\p{{L}}\\p{{N}}_\\[]*\\p{{L}}[^:|\\[\\]]*:{SP}*{NOT_SP}') is_label,
        regexp_matches(line, '(?i)^[^\\p{{L}}\\p{{N}}_\\[]*\\[{SP}*PAGE{SP}+\\p{{Nd}}+{SP}*\\]{SP}*$') is_tag, not regexp_matches(line, '{NOT_SP}') is_blank
        from (select parsed_id, unnest(generate_series(1, len(x))) n, unnest(x) line from (select parsed_id, string_split(raw_text, chr(10)) x from d))),
    g as (select *, sum((not (is_label or is_tag or is_blank))::int) over w g, coalesce(sum(is_row::int) over w, 0) rows_before from l window w as (partition by parsed_id order by n)),
    u as (select parsed_id, g, min(n) filter (is_label) a, max(n) filter (is_label) z from g where rows_before = 0 group by all having count(*) filter (is_label) >= 2),
    f as (select parsed_id, min(a) a, arg_min(z, a) z from u group by parsed_id),
    ti as (select f.parsed_id, arg_max(line, n) title from f join l on l.parsed_id = f.parsed_id and l.n < f.a and not is_tag and not is_blank group by all),
    h as (select f.* from f left join ti using (parsed_id) where not regexp_matches(coalesce(title, ''), '[.:;?!।]{SP}*$')),
    s as (select g.parsed_id, n, line, is_row, is_label and n between h.a and h.z is_head,
        case when is_row then 2 * rows_before when is_label and n between h.a and h.z then -1 when n < h.a then -2 else 2 * rows_before + 1 end seg from g left join h using (parsed_id)),
    v as (select parsed_id, seg, unnest(case when is_row then string_split(regexp_replace(line, '\\]', ']|'), '|') else [line] end) x, n, is_row or is_head apart from s),
    w as (select parsed_id, seg, n, apart, regexp_replace(lower(x), '[^\\p{{L}}\\p{{N}}]+', '', 'g') x from v),
    y as (select parsed_id, seg, case when bool_or(apart) then array_to_string(list_sort(list(x) filter (x <> '')), ',') else string_agg(x, '' order by n) end x from w group by parsed_id, seg),
    contents as (select parsed_id, coalesce(string_agg(case when seg % 2 = 0 and seg > 0 or seg = -1 then '=' else ':' end || x, '|' order by seg) filter (x <> ''), '') content from y group by parsed_id)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": f"""with {CONTENTS}, k as (select content, min(parsed_id) head from contents group by content)
            select head parsed_id, parsed_id copy_parsed_id from contents join k using (content) where parsed_id <> head""",
        "p4_collapsed": f"with {CONTENTS} select min(parsed_id) parsed_id, count(*) copies from contents group by content",
        "p7_pieces": _pieces_sql("select distinct parsed_id id, raw_text as text from parsed_documents where raw_text <> ''", "parsed_id"),
        "p7_chunk_pieces": _pieces_sql("select distinct chunk_id id, text from chunks where length(text) > 800", "chunk_id"),
        "p10_shared": """with d as (select distinct doc_id, text from documents where length(text) >= 200),
            g as (select doc_id, i::int - 1 a, md5(substring(text, i::int, 200)) g from (select doc_id, text, unnest(generate_series(1, length(text) - 199)) i from d)),
            r as (select g from g group by g having min(doc_id) <> max(doc_id)),
            p as (select doc_id, a, lag(a) over (partition by doc_id order by a) b from g join r using (g)),
            o as (select doc_id, a, sum(case when b is null or a > b + 200 then 1 else 0 end) over (partition by doc_id order by a) k from p),
            s as (select doc_id, k, min(a) a, max(a) + 200 z from o group by all),
            c as (select doc_id, string_agg(a || '-' || z, ';' order by a) spans, sum(z - a)::bigint shared_chars from s group by doc_id)
            select doc_id, min(doc_id) over (partition by text) class_id, spans, shared_chars, round(shared_chars / length(text), 6) share from d join c using (doc_id)""",
        "p3_found": f"with {LINES} select distinct parsed_id, line_no from keyed join many using (source_name, k)",
        "p3_clean": f"""with {LINES}, marked as (select keyed.*, m.k is not null gone from keyed left join many m using (source_name, k))
            select parsed_id, coalesce(string_agg(line, chr(10) order by line_no) filter (not gone), '') clean_text,
            count(*) filter (gone)::int removed_lines from marked group by parsed_id""",
        "p6_found": """with t as (select distinct chunk_id, text from chunks where text is not null),
            w as (select chunk_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') w from t),
            s as (select distinct chunk_id, unnest(case when len(w) < 3 then [array_to_string(w, ' ')]
                else list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) g from w),
            n as (select chunk_id, count(*) n from s group by all),
            c as (select a.chunk_id x, b.chunk_id y, count(*) i from s a join s b using (g) where a.chunk_id < b.chunk_id group by all)
            select x chunk_id, y other_chunk_id from c join n a on a.chunk_id = x join n b on b.chunk_id = y where 2 * i >= a.n + b.n - i""",
        "p6_groups": """with t as (select distinct chunk_id, text from chunks where text is not null),
            w as (select chunk_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') w from t),
            s as (select chunk_id, list_sort(list_distinct(case when len(w) < 5 then [array_to_string(w, ' ')]
                else list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' ')) end)) g from w),
            k as (select g, min(chunk_id) class_id, count(*) members from s group by g),
            u as (select class_id, len(g) n, unnest(g) g from k),
            c as (select a.class_id x, b.class_id y, any_value(a.n) n, any_value(b.n) m, count(*) i from u a join u b using (g) where a.class_id <> b.class_id group by all),
            l as (select x, count(*) links from c where i >= 0.8::double * (n + m - i) - 1e-9 group by x)
            select chunk_id, class_id, members, coalesce(links, 0) links from s join k using (g) left join l on x = class_id""",
        "p9_leaks": """with d as (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') w from documents),
            g as (select distinct doc_id, unnest(list_transform(generate_series(1, len(w) - 11), lambda i: array_to_string(w[i:i + 11], ' '))) g from d),
            e as (select item_id, regexp_extract_all(lower(passage), '[\\p{L}\\p{N}]+') w, list_distinct(regexp_extract_all(lower(coalesce(question, '')), '[\\p{L}\\p{N}]+')) q from eval_items),
            h as (select item_id, unnest(generate_series(1, len(w) - 11)) p, unnest(list_transform(generate_series(1, len(w) - 11), lambda i: array_to_string(w[i:i + 11], ' '))) g from e),
            m as (select doc_id, item_id, unnest(generate_series(p, p + 11)) p from g join h using (g)),
            n as (select doc_id, item_id, count(distinct p) covered from m group by all)
            select doc_id, item_id, round(covered / len(e.w), 6) passage_share,
                case when len(q) = 0 then 0 else round(len(list_intersect(q, list_distinct(d.w))) / len(q), 6) end question_share
            from n join e using (item_id) join d using (doc_id)""",
        "p10_found": """with g as (select distinct doc_id, substring(text, i::int, 200) g from (
                select doc_id, text, unnest(generate_series(1, length(text) - 199)) i from documents)),
            r as (select g, list(doc_id) d from g group by g having count(*) > 1),
            a as (select distinct d from r), b as (select unnest(d) x, d from a), c as (select x, unnest(d) y from b)
            select distinct x doc_id, y other_doc_id from c where x < y""",
        "p9_found": """with d as (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') w from documents),
            g as (select doc_id, unnest(list_transform(generate_series(1, len(w) - 11), lambda i: array_to_string(w[i:i + 11], ' '))) g from d),
            e as (select item_id, regexp_extract_all(lower(passage), '[\\p{L}\\p{N}]+') w from eval_items),
            h as (select item_id, unnest(list_transform(generate_series(1, len(w) - 11), lambda i: array_to_string(w[i:i + 11], ' '))) g from e)
            select distinct doc_id, item_id from g join h using (g)""",
        "p7_found": "select distinct chunk_id from chunks where length(text) > 800",
    }
