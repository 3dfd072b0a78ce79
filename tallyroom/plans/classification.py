"""Queries of the classification family: languages are the true classes, a rule on the source the prediction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyroom.operators import classify as C


def _key(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("source_path"), F.col("source").alias("document_type"), F.col("lang").alias("primary_workstream"))


def _output(s: SparkSession, d: str) -> DataFrame:
    docs = s.read.parquet(f"{d}/documents.parquet")
    pick = F.col("doc_id") % 4
    said = F.when(pick == 0, "en").when(pick == 1, F.col("lang")).when(pick == 2, "de").otherwise("other")
    return docs.select(F.col("doc_id").alias("source_path"), F.when(pick == 3, "src0").otherwise(F.col("source")).alias("document_type"), said.alias("primary_workstream"), (F.col("doc_id") % 10 == 0).alias("unsure"))


def _pairs(s, d):
    return C.paired(_key(s, d), _output(s, d))


def classify_totals(s, d):
    return C.totals(_pairs(s, d))


def classify_per_class(s, d):
    return C.per_class(_pairs(s, d))


def classify_confusion(s, d):
    return C.confusion(_pairs(s, d))


def coverage_mismatch(s, d):
    labels = s.read.parquet(f"{d}/labels.parquet").select(F.col("doc_id").alias("source_path"))
    return C.coverage(_key(s, d), labels.withColumn("source_path", F.when(F.col("source_path") % 50 == 0, -F.col("source_path") - 1).otherwise(F.col("source_path"))))


QUERIES = {f.__name__: f for f in (classify_totals, classify_per_class, classify_confusion, coverage_mismatch)}

_BASE = """
WITH pairs AS (SELECT doc_id, source AS document_type, lang AS expected, doc_id % 10 = 0 AS unsure, CASE WHEN doc_id % 4 = 3 THEN 'src0' ELSE source END AS said_type,
    CASE WHEN doc_id % 10 = 0 THEN NULL WHEN doc_id % 4 = 0 THEN 'en' WHEN doc_id % 4 = 1 THEN lang WHEN doc_id % 4 = 2 THEN 'de' ELSE 'other' END AS predicted FROM documents)
"""

ORACLE = {
    "classify_totals": _BASE + "SELECT count(*) AS documents, count(*) FILTER (document_type IS NOT DISTINCT FROM said_type) AS type_correct, count(*) FILTER (expected IS NOT DISTINCT FROM predicted) AS primary_correct, count(*) FILTER (unsure) AS unsure FROM pairs",
    "classify_per_class": _BASE + """, r AS (SELECT expected AS workstream, count(*) AS relevant, count(*) FILTER (expected = predicted) AS hit FROM pairs WHERE expected IS NOT NULL GROUP BY 1),
        f AS (SELECT predicted AS workstream, count(*) AS filed FROM pairs WHERE predicted IS NOT NULL GROUP BY 1)
        SELECT workstream, relevant, coalesce(filed, 0) AS filed, hit, round_even(hit / relevant, 4) AS recall, CASE WHEN filed > 0 THEN round_even(hit / filed, 4) END AS "precision" FROM r LEFT JOIN f USING (workstream)""",
    "classify_confusion": _BASE + "SELECT expected, predicted, count(*) AS n FROM pairs WHERE expected IS DISTINCT FROM predicted GROUP BY 1, 2",
    "coverage_mismatch": """WITH o AS (SELECT DISTINCT CASE WHEN doc_id % 50 = 0 THEN -doc_id - 1 ELSE doc_id END AS source_path FROM labels), k AS (SELECT DISTINCT doc_id AS source_path FROM documents)
        SELECT source_path, 'missing' AS side FROM k ANTI JOIN o USING (source_path) UNION ALL SELECT source_path, 'extra' FROM o ANTI JOIN k USING (source_path)""",
}
