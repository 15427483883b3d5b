"""Registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekiln.llm.consolidate import consolidate_matches
from lorekiln.llm.encode import encode_texts
from lorekiln.llm.history_dedup import history_duplicates
from lorekiln.llm.pack import pack_documents
from lorekiln.llm.reply_defects import fit_ends, fit_languages, fit_refusals, reply_defects
from lorekiln.llm.reading import fit_scale, reading_levels
from lorekiln.llm.shared_spans import shared_spans
from lorekiln.llm.survivor import best_representatives, duplicate_groups, question_key, retained_values
from lorekiln.plans.stage import spread


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = spread(_t(spark, sf, "validation_batch").select("record_id", "question", "answer", "explanation"))
    languages = fit_languages(_t(spark, sf, "documents"), pairs)
    replies = [F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in ("answer", "explanation")]
    replies = pairs.select(F.explode(F.array(*replies)).alias("r")).select("r.*")
    refusals = fit_refusals(replies.select("text").unionByName(pairs.select(F.col("question").alias("text"))))
    return reply_defects(pairs, languages, refusals, fit_ends(replies))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return consolidate_matches(_t(spark, sf, "quote_matches"), _t(spark, sf, "judge_batch"))


FIELDS = ["question_type", "hint_1", "explanation"]
MULTI = ["answer_variations", "semantic_entity_refs", "semantic_lore_concepts"]


def _groups(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    v = _t(spark, sf, "validation_batch")
    origin = F.concat_ws("\x1f", "question_source", F.col("original_question_id").cast("string"))
    origin = F.when(F.col("question_source").isNotNull() & F.col("original_question_id").isNotNull(), origin)
    return v, duplicate_groups(v, "record_id", [origin, question_key(F.col("question"))])


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    v, groups = _groups(spark, sf)
    trust = _t(spark, sf, "origin_trust").select("generation_model", "trust_rank")
    return best_representatives(v, groups, "record_id", FIELDS, "generation_model", "updated_at", trust, MULTI)


def p3_retained(spark: SparkSession, sf: str) -> DataFrame:
    v, groups = _groups(spark, sf)
    return retained_values(v, groups, "record_id", "generation_model", MULTI)[0]


def p3_quality(spark: SparkSession, sf: str) -> DataFrame:
    v, groups = _groups(spark, sf)
    return retained_values(v, groups, "record_id", "generation_model", MULTI)[1]


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return shared_spans(_t(spark, sf, "judge_batch"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    rows = _t(spark, sf, "staging_batch").select("staging_id", "batch_no", "question", "source_quote")
    return history_duplicates(spread(rows))


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode_texts(spread(_t(spark, sf, "documents").select("doc_id", "text")))


def p8_packing(spark: SparkSession, sf: str) -> DataFrame:
    sizes = encode_texts(spread(_t(spark, sf, "documents").select("doc_id", "text")), sizes_only=True)
    return pack_documents(sizes, _t(spark, sf, "prompt_windows"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    story = (F.col("lang") == "en") & F.col("doc_kind").isin("chapter", "recap")
    scale = fit_scale(_t(spark, sf, "reading_passages"))
    texts = _t(spark, sf, "documents").where(story).select("doc_id", "text")
    return reading_levels(spread(texts), scale).select("doc_id", "reading_level")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p3_retained": p3_retained,
    "p3_quality": p3_quality,
    "p4_found": p4_found,
    "p6_found": p6_found,
    "p7_ids": p7_ids,
    "p8_packing": p8_packing,
    "p9_found": p9_found,
}

ORACLE_SQL: dict[str, str] = {}
