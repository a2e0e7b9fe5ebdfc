"""Registry of queries: a Spark query and, where SQL can express it, its twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function (spark, folder) -> DataFrame and its SQL twin."""

    def register(f):
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"two queries named {key}")
        QUERIES[key] = f
        if sql:
            ORACLE[key] = sql
        return f

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# A number in [0, 1) for each value of a column, the same in both dialects: the first 32 bits of its digest.
def turn(column: str):
    return F.conv(F.substring(F.md5(F.concat(F.lit("42|"), (F.col(column) if isinstance(column, str) else column).cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296


def turn_sql(column: str) -> str:
    return f"('0x' || substr(md5('42|' || {column}), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


# A response of each of eight forms per record; valid in both dialects.
LETTER = "substr('ABCDE', cast(1 + record_id % 5 as int), 1)"
RESPONSE = f"""CASE record_id % 8
 WHEN 0 THEN '<think>' || coalesce(cot, '') || chr(10) || 'Final answer: ' || {LETTER} || '.' || '</think> <answer>' || {LETTER} || '. sure</answer>'
 WHEN 1 THEN 'The answer is (' || {LETTER} || ') of course'
 WHEN 2 THEN 'so ' || chr(92) || 'boxed' || '{{' || lower({LETTER}) || 'x}}'
 WHEN 3 THEN {LETTER} || '. first option' || chr(10) || question
 WHEN 4 THEN 'so ' || coalesce(answer, '') || chr(10) || {LETTER}
 WHEN 5 THEN 'Answer: ' || {LETTER} || ' then'
 WHEN 6 THEN '<answer>' || coalesce(answer, '') || '</answer'
 ELSE coalesce(cot, '') END"""
RESPONSES = f"responses AS (SELECT record_id, dataset, split, question, answer, cot, {LETTER} AS letter, {RESPONSE} AS text FROM cot_records)"


def responses(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "cot_records").select(
        "record_id", "dataset", "split", "question", "answer", "cot", F.expr(LETTER).alias("letter"), F.expr(RESPONSE).alias("text")
    )
