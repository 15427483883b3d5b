"""Registered queries of the core and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lorekiln.plans import core_queries, reference_queries, reference_queries_2, reference_queries_3, reference_queries_4  # noqa: F401  (register their queries)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**core_queries.QUERIES, **reference_queries.QUERIES}
ORACLE_SQL: dict[str, str] = {**reference_queries.ORACLE_SQL}
FLAGSHIP = "tfidf_ngram_rank"
