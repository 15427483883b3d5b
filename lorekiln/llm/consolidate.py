"""Pairwise match results consolidated into groups of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekiln.llm.components import grid_components

_WIDE = "".join(chr(c) for c in [*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B)])
_PLAIN = "".join(chr(ord(c) - 0xFEE0) for c in _WIDE)


def id_key(c: Column) -> Column:
    """An id without case, separators, blanks, signs and character width."""
    return F.upper(F.regexp_replace(F.translate(c, _WIDE, _PLAIN), r"[^\p{L}\p{N}]+", ""))


def consolidate_matches(
    matches: DataFrame,
    records: DataFrame,
    a: str = "temp_qid_a",
    b: str = "temp_qid_b",
    verdict: str = "is_match",
    record_id: str = "temp_qid",
    cell_edges: int = 50_000,
) -> DataFrame:
    """One group for each record linked, directly or through others: (``record_id``, group_qid).

    A row of ``matches`` links if its verdict is true and both ids, however spelled, belong to ``records``; nulls,
    unknown ids and self-pairs link nothing, repeated pairs count once. ``group_qid`` is the smallest id of the group
    in the spelling of ``records``; where two records differ only in spelling, the smaller spelling stands for the
    key. Other columns of either table are not read. Empty tables: an empty result.
    """
    known = records.where(F.col(record_id).isNotNull()).groupBy(id_key(F.col(record_id)).alias("_key"))
    known = known.agg(F.min(record_id).alias("_id")).where("_key <> ''")
    pairs = matches.where(F.col(verdict)).select(id_key(F.col(a)).alias("_a"), id_key(F.col(b)).alias("_b"))
    pairs = pairs.where("_a <> _b").select(F.least("_a", "_b").alias("_a"), F.greatest("_a", "_b").alias("_b")).distinct()
    for end in ("a", "b"):
        mine = known.select(F.col("_key").alias(f"_{end}"), F.col("_id").alias(f"id_{end}"))
        pairs = pairs.join(mine, f"_{end}")
    groups = grid_components(pairs, "id_a", "id_b", cell_edges)
    return groups.select(F.col("vertex").alias(record_id), F.col("label").alias("group_qid"))
