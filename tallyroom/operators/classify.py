"""Scoring a classification against its key.

Both tables: source_path, document_type, primary_workstream, and for the output unsure.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def coverage(key: DataFrame, output: DataFrame) -> DataFrame:
    """source_path, side: paths in one table only ('missing' from the output, or 'extra' in it)."""
    k, o = key.select("source_path").distinct().withColumn("k", F.lit(1)), output.select("source_path").distinct().withColumn("o", F.lit(1))
    return k.join(o, "source_path", "full").where("k IS NULL OR o IS NULL").select("source_path", F.when(F.col("o").isNull(), "missing").otherwise("extra").alias("side"))


def paired(key: DataFrame, output: DataFrame) -> DataFrame:
    """expected and predicted of each path; an unsure row predicts no workstream but keeps its type."""
    o = output.select("source_path", F.col("document_type").alias("said_type"), F.when(F.coalesce("unsure", F.lit(False)), None).otherwise(F.col("primary_workstream")).alias("predicted"), F.coalesce("unsure", F.lit(False)).alias("unsure"))
    return key.select("source_path", "document_type", F.col("primary_workstream").alias("expected")).join(o, "source_path")


def totals(pairs: DataFrame) -> DataFrame:
    """documents, type_correct, primary_correct, unsure; a missing truth with a missing prediction is correct."""
    return pairs.agg(F.count("*").alias("documents"), F.count_if(F.col("document_type").eqNullSafe(F.col("said_type"))).alias("type_correct"), F.count_if(F.col("expected").eqNullSafe(F.col("predicted"))).alias("primary_correct"), F.count_if("unsure").alias("unsure"))


def per_class(pairs: DataFrame) -> DataFrame:
    """workstream, relevant, filed, hit, recall, precision (rounded half-even to 4 places, null where undefined), for classes of the key."""
    relevant = pairs.where("expected IS NOT NULL").groupBy(F.col("expected").alias("workstream")).agg(F.count("*").alias("relevant"), F.count_if(F.col("expected").eqNullSafe(F.col("predicted"))).alias("hit"))
    filed = pairs.where("predicted IS NOT NULL").groupBy(F.col("predicted").alias("workstream")).agg(F.count("*").alias("filed"))
    joined = relevant.join(filed, "workstream", "left").withColumn("filed", F.coalesce("filed", F.lit(0)))
    part = lambda n: F.when(F.col(n) > 0, F.bround(F.col("hit") / F.col(n), 4))
    return joined.select("workstream", "relevant", "filed", "hit", part("relevant").alias("recall"), part("filed").alias("precision"))


def confusion(pairs: DataFrame, top: int | None = None) -> DataFrame:
    """expected, predicted, n of wrong pairs, commonest first; ``top`` of them in a report."""
    wrong = pairs.where(~F.col("expected").eqNullSafe(F.col("predicted"))).groupBy("expected", "predicted").agg(F.count("*").alias("n"))
    ordered = wrong.orderBy(F.desc("n"), F.coalesce("expected", F.lit("")), F.coalesce("predicted", F.lit("")))
    return ordered.limit(top) if top else ordered


def confusion_shown(pairs: DataFrame, top: int = 15) -> DataFrame:
    """expected, predicted, n, left: the ``top`` commonest wrong pairs, each with the number of pairs that are not shown."""
    every = confusion(pairs)
    rest = every.agg(F.greatest(F.count("*") - top, F.lit(0)).alias("left"))
    return confusion(pairs, top).join(rest)  # one row beside ``top``
