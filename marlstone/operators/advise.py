"""From questions to parsed answers: retrieval, context, prompt, generation, layered parsing and answer confidence, for a batch of questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import plugins
from ..config import SETTINGS, Settings
from ..functions import text as T
from ..runtime import cut
from . import answer, confidence, index, retrieve

# fixed values: phrases of unsafe queries
UNSAFE = ["ignore previous", "system prompt", "forget instructions", "override"]


def advise(asked: DataFrame, collection: DataFrame, bm25: index.BM25Index, generator: Callable[[], plugins.Generator], settings: Settings = SETTINGS) -> DataFrame:
    """(query_id, status, short_answer, classification, reasoning, risk_flags, sources, retrieval_confidence, answer_confidence, review_reason).

    asked(query_id, query, q_vec); collection(id, vec, text, source_name, doc_type, reference_number, page_number). Every question has a row: ``unsafe`` ones
    aren't asked, those without a source or a response have no answer; a NULL question has no source. Retrieved sets and contexts are bounded by ``top_k``."""
    said = asked.select("query_id", "query", F.when(F.col("query").isNotNull(), F.col("q_vec")).alias("q_vec"), F.coalesce(T.matches_any(F.col("query"), UNSAFE), F.lit(False)).alias("unsafe"))
    safe = cut(said.where(~F.col("unsafe")).select("query_id", T.normalise_query(F.col("query")).alias("query"), "q_vec"))
    sparse = index.normalise(index.top_k(index.scores(bm25, index.query_terms(safe, "query_id", "query")), settings.bm25_k))
    found = cut(retrieve.hybrid(safe.select("query_id", "q_vec"), collection.select("id", "vec"), sparse, settings)
                .join(collection.drop("vec"), "id"))
    scored = confidence.signals(found.withColumn("similarity", F.col("score")), settings)
    sources = found.select("query_id", F.col("position").alias("rank"), F.col("id").alias("doc_id"), "source_name", "reference_number", "page_number",
                           F.col("text").alias("chunk_text"))
    told = safe.join(answer.context(sources), "query_id").withColumn("prompt", answer.prompt(F.col("query"), F.col("source_list"), F.col("context")))
    replied = cut(plugins.generate(told.select("query_id", "prompt"), "prompt", generator).drop("prompt"))
    parsed = answer.parse_responses(replied.where("response is not null"), "response").select("query_id", "parsed.*")
    texts = found.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: x["text"]).alias("texts"))
    answered = cut(parsed.join(texts, "query_id"))
    support = answer.claim_support(answered, "query_id", "short_answer", "texts").select("query_id", "support")
    whole = confidence.with_empty(safe, scored).join(safe.select("query_id", "query"), "query_id").join(answered.join(support, "query_id"), "query_id", "left")
    evidence = answer.overlap_score(F.col("short_answer"), F.array_join("texts", " "))
    final = F.when(F.col("short_answer").isNotNull(), answer.answer_confidence(evidence, F.col("support"), F.col("confidence_score"), F.size("texts"), settings))
    reason = confidence.review_reason(F.col("confidence_score"), F.col("top_similarity"), F.col("strong_chunks"), F.col("query"), settings)
    rows = whole.select(
        "query_id", F.when(F.col("n_chunks") == 0, "no_sources").when(F.col("short_answer").isNull(), "no_response").otherwise("answered").alias("status"),
        "short_answer", "classification", "reasoning", "risk_flags", F.col("n_chunks").alias("sources"), F.col("confidence_score").alias("retrieval_confidence"),
        final.alias("answer_confidence"), reason.alias("review_reason"))
    refused = said.where("unsafe").select("query_id", F.lit("unsafe").alias("status"))
    return rows.unionByName(refused, allowMissingColumns=True)
