"""Batch evaluation of answers: a cascade of exact, fuzzy, structured and judged checks as one expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorekiln.functions import questions as fq

#: Thresholds of the cascades.
FUZZY, MCQ_SIMILAR, MCQ_MARGIN = 0.85, 0.75, 0.30
FR_SIMILAR, FR_FLOOR, FR_BOOST, FR_WORDS = 0.80, 0.50, 0.10, 6
EX_FUZZY, EX_FLOOR = 0.95, 0.40


def evaluate_fr(player: Column, gold: Column, fuzzy: Column, similarity: Column, entity_hit: Column, judge: Column) -> Column:
    """Tier of a recall answer: exact, fuzzy, judged when long, by similarity, by similarity with a known entity."""
    long = (fq.word_count(player) > FR_WORDS) | ((fq.word_count(player) >= 2 * fq.word_count(gold)) & (fq.word_count(player) >= 8))
    boosted = F.least(similarity + FR_BOOST, F.lit(1.0))
    return (
        F.when(player == gold, "fr_exact")
        .when(fuzzy >= FUZZY, "fr_fuzzy")
        .when(long, F.when(judge, "fr_llm_judge_pass").otherwise("fr_llm_judge_fail"))
        .when(similarity >= FR_SIMILAR, "fr_passed_primary_semantic")
        .when((similarity >= FR_FLOOR) & entity_hit & (boosted >= FR_SIMILAR), "fr_passed_semantic_boosted")
        .otherwise("fr_failed_primary_semantic")
    )


def evaluate_mcq(player: Column, gold: Column, fuzzy: Column, similarity: Column, margin: Column) -> Column:
    return (
        F.when(player == gold, "mcq_exact")
        .when(fuzzy >= FUZZY, "mcq_fuzzy")
        .when((similarity >= MCQ_SIMILAR) & (margin >= MCQ_MARGIN), "mcq_passed_semantic")
        .otherwise("mcq_failed_semantic")
    )


def evaluate_ex(player: Column, gold: Column, fuzzy: Column, similarity: Column, judge: Column) -> Column:
    """Tier of an explanatory answer: similarity alone never passes; low similarity fails unless the answer is long."""
    verbose = fq.word_count(player) >= 2 * fq.word_count(gold)
    judged = F.when(judge, "ex_llm_judge_pass").otherwise("ex_llm_judge_fail")
    return (
        F.when(player == gold, "ex_exact")
        .when(fuzzy >= EX_FUZZY, "ex_fuzzy")
        .when((similarity < EX_FLOOR) & ~verbose, "ex_failed_semantic")
        .otherwise(judged)
    )


def evaluate_numeric(player: Column, gold: Column) -> Column:
    p, g = fq.single_number(fq.digits_for_words(player)), fq.single_number(fq.digits_for_words(gold))
    return (
        F.when(g.isNull(), "numeric_exact_fail_invalid_gold")
        .when(p.isNull(), "numeric_exact_fail_invalid_or_no_num")
        .when(p == g, "numeric_exact_pass")
        .otherwise("numeric_exact_fail")
    )
