"""Registered queries of the core's general operators for training data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lorekiln.operators.schema_drift import field_lineage, migration_steps, schema_changes, typed_records, unify_records


def _raw(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/judge_raw.parquet")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return schema_changes(_raw(spark, sf))[0]


def p5_unified(spark: SparkSession, sf: str) -> DataFrame:
    raw = _raw(spark, sf)
    changes, schemas, files = schema_changes(raw)
    lineage = field_lineage(changes, schemas, files)
    steps = migration_steps(raw, lineage, schemas, files)
    return typed_records(unify_records(raw, lineage, files, steps=steps), steps)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p5_found": p5_found, "p5_unified": p5_unified}
