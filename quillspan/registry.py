"""All queries of the engine and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspan.plans import detection, documents, threads, typesetting

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {**detection.QUERIES, **documents.QUERIES, **threads.QUERIES, **typesetting.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**detection.SQL, **documents.SQL, **threads.SQL, **typesetting.SQL}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detection.redact_text(spark, sf_dir)
