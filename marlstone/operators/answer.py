"""Answer assembly: context and source lists, layered parsing of responses, claims and their support, answer confidence."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SETTINGS, Settings
from ..functions.bind import let
from ..functions.text import strip, tokens
from ..functions.vector import clamp

# fixed values: the headers of a sectioned response, in order
SECTIONS = ("SHORT_ANSWER", "CLASSIFICATION", "REASONING", "ALTERNATE_VIEWS", "RISK_FLAGS", "CONFIDENCE_NOTE")
PARSED = ("struct<short_answer:string,classification:string,reasoning:string,alternate_views:string,risk_flags:array<string>,"
          "confidence_note:string>")


def context(rows: DataFrame, query_col: str = "query_id") -> DataFrame:
    """(query, context, source_list): numbered sources with their text, and each document's name once, the last name at the first place.
    rows(query, rank, doc_id, source_name, reference_number, page_number, chunk_text); a query's retrieved set is bounded by top_k."""
    ref = F.when(F.coalesce("reference_number", F.lit("")) != "", F.concat(F.lit(" | Ref: "), "reference_number")).otherwise("")
    page = F.when(F.coalesce("page_number", F.lit(0)) != 0, F.concat(F.lit(" | Page: "), F.col("page_number").cast("string"))).otherwise("")
    part = F.concat(F.lit("[SOURCE "), F.col("rank").cast("string"), F.lit("] "), "source_name", ref, page, F.lit("\n"), "chunk_text")
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("rank", c))), lambda x: x["v"])
    texts = rows.select(query_col, "rank", part.alias("v")).groupBy(query_col).agg(F.array_join(in_order("v"), "\n\n---\n\n").alias("context"))
    names = (rows.groupBy(query_col, "doc_id").agg(F.min("rank").alias("rank"), F.max_by("source_name", "rank").alias("v"))
             .groupBy(query_col).agg(F.array_join(F.transform(in_order("v"), lambda x: F.concat(F.lit("- "), x)), "\n").alias("source_list")))
    return texts.join(names, query_col)


def without_fences(c: Column) -> Column:
    """A response that begins with a code fence, without its fence lines."""
    text = strip(c)
    lines = F.filter(F.split(text, "\n"), lambda x: ~F.startswith(F.ltrim(x), F.lit("```")))
    return F.when(F.startswith(text, F.lit("```")), strip(F.array_join(lines, "\n"))).otherwise(text)


# fixed values: the keys of a response object, in order
KEYS = ("short_answer", "classification", "reasoning", "alternate_views", "risk_flags", "confidence_note")


def _read_json(raw: str | None) -> tuple:
    """Strict JSON: the whole text must be one non-empty object; missing keys get defaults and a flag that is text becomes a list."""

    def text(x, default=None):
        return default if x is None else x if isinstance(x, str) else json.dumps(x)

    try:
        v = json.loads(raw)
    except (TypeError, ValueError):
        v = None
    if not isinstance(v, dict) or not v:
        return (None,) * len(KEYS)
    flags = v.get("risk_flags", [])
    flags = flags if isinstance(flags, list) else [flags] if flags else []
    return (text(v.get("short_answer"), ""), text(v.get("classification")), text(v.get("reasoning"), ""), text(v.get("alternate_views")),
            [text(f, "") for f in flags], text(v.get("confidence_note"), ""))


def json_layer(raw: Column) -> Column:
    """The response object as a struct; all of it NULL if the text isn't one."""

    @F.pandas_udf(PARSED)
    def read(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_read_json(x) for x in texts], columns=list(KEYS))

    return read(raw)


def sections_layer(raw: Column) -> Column:
    """The parts of a response written under ``KEY:`` lines, NULL if there is none. Text behind a header replaces what an earlier header of
    that name gave; other lines are appended to the last header."""
    lines = F.split(strip(raw), "\n")
    header = lambda line: F.regexp_extract(strip(line), r"^(" + "|".join(SECTIONS) + "):", 1)
    start = F.struct(F.lit("").alias("current"), F.create_map(F.lit("").cast("string"), F.lit("").cast("string")).alias("got"))

    def put(got: Column, key: Column, value: Column) -> Column:
        return F.map_concat(F.map_filter(got, lambda k, _: k != key), F.map_from_arrays(F.array(key), F.array(value)))

    def step(acc: Column, line: Column) -> Column:
        key = header(line)
        inline = strip(F.substring(strip(line), F.length(key) + 2, F.length(line)))
        old = F.coalesce(F.element_at(acc["got"], acc["current"]), F.lit(""))
        more = F.when(old == "", line).otherwise(F.concat(old, F.lit("\n"), line))
        return F.struct(
            F.when(key != "", key).otherwise(acc["current"]).alias("current"),
            F.when((key != "") & (inline != ""), put(acc["got"], key, inline))
            .when((key == "") & (acc["current"] != ""), put(acc["got"], acc["current"], more)).otherwise(acc["got"]).alias("got"))

    return let(F.aggregate(lines, start, step)["got"], _section_values)


def _section_values(got: Column) -> Column:
    """The struct of a response from its texts by header, NULL if all are blank."""
    none = F.array().cast("array<string>")
    value = lambda k: strip(F.coalesce(F.element_at(got, F.lit(k)), F.lit("")))
    flags = lambda text: F.filter(F.transform(F.split(text, "\n"), lambda x: strip(F.regexp_replace(strip(x), r"^[-•*]+", ""))), lambda x: x != "")
    whole = lambda v: F.struct(
        F.get(v, 0).alias("short_answer"), F.nullif(F.get(v, 1), F.lit("")).alias("classification"), F.get(v, 2).alias("reasoning"),
        F.nullif(F.get(v, 3), F.lit("")).alias("alternate_views"), F.when(F.upper(F.get(v, 4)).isin("NONE", ""), none).otherwise(flags(F.get(v, 4))).alias("risk_flags"),
        F.get(v, 5).alias("confidence_note"))
    return let(F.array(*(value(k) for k in SECTIONS)), lambda v: F.when(F.exists(v, lambda x: x != ""), whole(v)))


def raw_layer(raw: Column) -> Column:
    """The text itself: the answer is its first 500 characters."""
    blank = F.coalesce(strip(raw), F.lit("")) == ""
    return F.struct(
        F.when(blank, F.lit("Unable to parse LLM response.")).otherwise(F.substring(raw, 1, 500)).alias("short_answer"),
        F.lit(None).cast("string").alias("classification"), F.coalesce(raw, F.lit("")).alias("reasoning"),
        F.lit(None).cast("string").alias("alternate_views"), F.array(F.lit("llm_response_parse_failed")).alias("risk_flags"),
        F.lit("").alias("confidence_note"))


def parse_responses(rows: DataFrame, raw_col: str = "raw") -> DataFrame:
    """Adds parsed (the first layer that reads the response: JSON, sections, raw) and layer."""
    raw = F.col(raw_col)
    layered = rows.withColumn("_json", json_layer(without_fences(raw))).withColumn("_sections", sections_layer(raw))
    is_json = F.col("_json.short_answer").isNotNull()
    return (layered.withColumn("layer", F.when(is_json, "json").when(F.col("_sections").isNotNull(), "sections").otherwise("raw"))
            .withColumn("parsed", F.when(is_json, F.col("_json").cast(PARSED)).when(F.col("_sections").isNotNull(), F.col("_sections").cast(PARSED))
                        .otherwise(raw_layer(raw).cast(PARSED)))
            .drop("_json", "_sections"))


def claims(answer: Column) -> Column:
    """Stripped sentences and lines of more than 15 characters."""
    return F.filter(F.transform(F.split(answer, r"[.!?\n]"), strip), lambda x: F.length(x) > 15)


def overlap_score(claim: Column, text: Column) -> Column:
    """Stand-in scorer: the share of the claim's distinct tokens that the text has."""
    a, b = F.array_distinct(tokens(claim)), F.array_distinct(tokens(text))
    return F.round(F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(a)), F.lit(0.0)), 6)


def claim_support(rows: DataFrame, id_col: str, answer_col: str, texts_col: str, cut: float = 0.7) -> DataFrame:
    """(id, n_claims, supported, support): a claim is supported if its best score over the texts reaches ``cut``; without claims support is 0.5.
    Each row holds its own claims and texts, so nothing is shuffled."""
    best = F.transform("claims", lambda c: F.coalesce(F.array_max(F.transform(F.col(texts_col), lambda t: overlap_score(c, t))), F.lit(0.0)))
    return (rows.select(id_col, texts_col, claims(F.col(answer_col)).alias("claims")).withColumn("best", best)
            .select(id_col, F.size("claims").cast("bigint").alias("n_claims"), F.size(F.filter("best", lambda s: s >= cut)).cast("bigint").alias("supported"))
            .withColumn("support", F.when(F.col("n_claims") == 0, 0.5).otherwise(F.round(F.try_divide("supported", "n_claims"), 6))))


def answer_confidence(evidence: Column, support: Column, retrieval: Column, chunks: Column, settings: Settings = SETTINGS) -> Column:
    """Weighted evidence, support, retrieval confidence and number of chunks (5 are enough), less 0.2 unless support exceeds 0.8."""
    a, b, c, d = settings.answer_weights
    total = a * clamp(evidence) + b * support + c * retrieval + d * F.least(chunks / 5.0, F.lit(1.0)) - F.when(support > 0.8, 0.0).otherwise(0.2)
    return F.round(clamp(F.round(total, 9)), 3)


PROMPT = (
    "Answer from the sources below and name them; say so where they don't hold the answer.\n\nQuestion: {query}\n\nSources:\n{sources}\n\nContext:\n{context}\n\n"
    "Reply with one JSON object and nothing else. Its keys: short_answer, classification (null if none), reasoning, alternate_views (null if none), "
    "risk_flags (a list), confidence_note.")


def prompt(query: Column, sources: Column, text: Column) -> Column:
    """The three slots of the prompt filled."""
    out: Column = F.lit("")
    for piece in PROMPT.replace("{query}", "\0q\0").replace("{sources}", "\0s\0").replace("{context}", "\0c\0").split("\0"):
        out = F.concat(out, {"q": query, "s": sources, "c": text}.get(piece, F.lit(piece)))
    return out
