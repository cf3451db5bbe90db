"""Retrieval confidence: four signals of a query's retrieved set and their weighted sum, in one aggregation per query."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT_TYPE, SETTINGS, Settings
from ..functions.vector import clamp


def authority(doc_type: Column, settings: Settings = SETTINGS) -> Column:
    table = F.create_map(*(F.lit(x) for x in chain.from_iterable(settings.authority.items())))
    return F.coalesce(F.try_element_at(table, doc_type), F.lit(settings.authority[DEFAULT_TYPE]))


def harmonic_mean(rows: DataFrame, query_col: str = "query_id", score_col: str = "similarity") -> DataFrame:
    """(query, n_chunks, top, weighted_mean): scores weighted by one over their rank."""
    w = Window.partitionBy(query_col).orderBy(F.desc(score_col))
    ranked = rows.select(query_col, F.col(score_col).alias("s"), F.row_number().over(w).alias("r"))
    return ranked.groupBy(query_col).agg(
        F.count("*").alias("n_chunks"), F.max("s").alias("top"), F.round(F.sum(F.col("s") / F.col("r")) / F.sum(1.0 / F.col("r")), 9).alias("weighted_mean"))


def signals(rows: DataFrame, settings: Settings = SETTINGS, query_col: str = "query_id", score_col: str = "similarity",
            type_col: str = "doc_type") -> DataFrame:
    """One row per query: counts, the four signals and the confidence score, unrounded signals in the sum."""
    w = Window.partitionBy(query_col).orderBy(F.desc(score_col))
    ranked = rows.select(query_col, F.col(score_col).alias("s"), F.col(type_col).alias("t"), F.row_number().over(w).alias("r"))
    base = ranked.groupBy(query_col).agg(
        F.count("*").alias("n"), F.max("s").alias("top"), F.round(F.sum(F.col("s") / F.col("r")) / F.sum(1.0 / F.col("r")), 9).alias("wm"),
        F.min("s").alias("least"), F.round(F.avg(authority(F.col("t"), settings)), 9).alias("auth"), F.round(F.stddev_samp("s"), 9).alias("sd"),
        F.count_if(F.col("s") >= settings.strong).alias("strong"), F.array_sort(F.collect_set("t")).alias("types"))
    top, wm, least = F.col("top"), F.col("wm"), F.col("least")
    quality = clamp(F.when(top < settings.weak, top * 0.5).when(top < settings.strong, wm * 0.85)
                    .when(least >= settings.strong, wm * 1.08).otherwise(wm))
    agreement = F.when(F.col("n") >= 2, clamp(1 - F.col("sd") / 0.30)).otherwise(F.lit(0.5))
    coverage = clamp(F.col("strong") / settings.min_coverage)
    a, b, c, d = settings.confidence_weights
    parts = base.withColumns({"quality": quality, "source": clamp(F.col("auth")), "agreement": agreement, "coverage": coverage})
    score = F.round(clamp(F.round(a * F.col("quality") + b * F.col("source") + c * F.col("agreement") + d * F.col("coverage"), 9)), 3)
    return parts.select(
        query_col, F.col("n").alias("n_chunks"), F.round("top", 4).alias("top_similarity"), F.round("wm", 4).alias("weighted_mean_similarity"),
        F.round(F.coalesce("sd", F.lit(0.0)), 4).alias("score_stdev"), F.col("strong").alias("strong_chunks"), F.col("types").alias("unique_doc_types"),
        F.round("quality", 3).alias("retrieval_quality"), F.round("source", 3).alias("source_authority"),
        F.round("agreement", 3).alias("source_agreement"), F.round("coverage", 3).alias("coverage_bonus"), score.alias("confidence_score"))


def with_empty(queries: DataFrame, scored: DataFrame, query_col: str = "query_id") -> DataFrame:
    """A query without retrieved rows stays, with signals and a score of 0."""
    zero = ["retrieval_quality", "source_authority", "source_agreement", "coverage_bonus", "confidence_score"]
    return (queries.select(query_col).join(scored, query_col, "left").fillna(0, ["n_chunks", "strong_chunks"])
            .fillna(0.0, [c for c in zero if c in scored.columns]))


def review_reason(score: Column, top: Column, strong: Column, query: Column, settings: Settings = SETTINGS) -> Column:
    """Why a result should be looked at, NULL if it needn't; the first rule that holds. Numbers are shown to 2 places, halves up."""
    # fixed values: the wording of the reasons
    shown = lambda c: F.round(c.cast("decimal(6,3)"), 2).cast("string")
    return (F.when(top.isNull(), F.lit("No chunks retrieved — query may be out of scope"))
            .when(score < settings.threshold, F.concat(F.lit("Confidence score "), shown(score), F.lit(f" is below threshold {settings.threshold:.2f}")))
            .when(top < settings.weak, F.concat(F.lit("Best retrieved chunk has low similarity ("), shown(top), F.lit(") — query may be out of scope")))
            .when(strong == 0, F.lit("No strongly matching chunks found — answer may be incomplete"))
            .when((F.trim(query) != "") & (F.size(F.split(F.trim(query), r"\s+")) < 4), F.lit("Query is very short — may be ambiguous or under-specified")))
