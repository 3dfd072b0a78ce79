"""Scoring a tool's reports against a key of findings.

Tables: reports (tool_index, documents array), evidence (finding_id, rel_path), findings (finding_id, severity,
multi_document), distractors (distractor_id, location), adjudications (tool_index, finding_ids array; an empty array
means that the report matches nothing).

Joins are equi-joins on paths and ids; which side is broadcast, Spark decides by measured size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEVERITIES = ("critical", "high", "medium", "low")


def cited(reports: DataFrame) -> DataFrame:
    """(tool_index, rel_path), once each."""
    return reports.select("tool_index", F.explode("documents").alias("rel_path")).distinct()


def matches(cites: DataFrame, evidence: DataFrame) -> DataFrame:
    """(tool_index, finding_id): a report is credited with every finding one of whose documents it cites."""
    return cites.join(evidence, "rel_path").select("tool_index", "finding_id").distinct()


def prematch(cites: DataFrame, evidence: DataFrame) -> DataFrame:
    """tool_index, finding_ids (sorted); reports without a match are missing."""
    return cites.join(evidence, "rel_path").groupBy("tool_index").agg(F.array_sort(F.collect_set("finding_id")).alias("finding_ids"))


def unmatched(reports: DataFrame, matched: DataFrame) -> DataFrame:
    return reports.select("tool_index").join(matched, "tool_index", "left_anti")


def adjudicated(matched: DataFrame, adjudications: DataFrame) -> DataFrame:
    """tool_index, finding_ids, corrected: an adjudication replaces the match, also by nothing; corrected where there was one."""
    ruled = adjudications.select("tool_index", F.col("finding_ids").alias("ruled"))
    both = matched.join(ruled, "tool_index", "full").select("tool_index", F.coalesce("ruled", "finding_ids").alias("finding_ids"), (F.col("ruled").isNotNull() & F.col("finding_ids").isNotNull()).alias("corrected"))
    return both


def standing(decided: DataFrame) -> DataFrame:
    """(tool_index, finding_id) after adjudication."""
    return decided.select("tool_index", F.explode("finding_ids").alias("finding_id"))


def distractor_routing(cites: DataFrame, distractors: DataFrame, standing_pairs: DataFrame) -> DataFrame:
    """(distractor_id, route): 'citation' from a report that stands for a finding, else 'false alarm'.  Of distractors
    at one location the last (greatest id) counts.  Only the location is matched."""
    last = distractors.groupBy("location").agg(F.max("distractor_id").alias("distractor_id"))
    hits = cites.join(last, cites["rel_path"] == last["location"]).select("tool_index", "distractor_id")
    stood = standing_pairs.select("tool_index").distinct().withColumn("stood", F.lit(True))
    return hits.join(stood, "tool_index", "left").select("distractor_id", F.when(F.col("stood"), "citation").otherwise("false alarm").alias("route")).distinct()


def ratio(part, whole):
    """0.0 where there is nothing to divide by."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def metrics(findings: DataFrame, n_reports: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row: found, n_findings, matched_reports, n_reports, recall, precision.  Precision counts reports, not findings."""
    found = pairs.join(findings.select("finding_id"), "finding_id", "left_semi").agg(F.countDistinct("finding_id").alias("found"))
    good = pairs.agg(F.countDistinct("tool_index").alias("matched_reports"))
    total = findings.agg(F.count("*").alias("n_findings"))
    reports = n_reports.agg(F.count("*").alias("n_reports"))
    one = found.crossJoin(total).crossJoin(good).crossJoin(reports)  # four frames of one row
    return one.withColumn("recall", ratio(F.col("found"), F.col("n_findings"))).withColumn("precision", ratio(F.col("matched_reports"), F.col("n_reports")))


def recall_by_severity(findings: DataFrame, pairs: DataFrame, bands=SEVERITIES) -> DataFrame:
    """severity, found, total for every band, empty ones too."""
    spark = findings.sparkSession
    hit = pairs.select("finding_id").distinct().withColumn("hit", F.lit(1))
    counts = findings.join(hit, "finding_id", "left").groupBy("severity").agg(F.count("hit").alias("found"), F.count("*").alias("total"))
    every = spark.createDataFrame([(b,) for b in bands], "severity string")
    return every.join(counts, "severity", "left").select("severity", F.coalesce("found", F.lit(0)).alias("found"), F.coalesce("total", F.lit(0)).alias("total"))


def misses(findings: DataFrame, pairs: DataFrame) -> DataFrame:
    return findings.select("finding_id").join(pairs, "finding_id", "left_anti")


def partial_trails(findings: DataFrame, evidence: DataFrame, cites: DataFrame, pairs: DataFrame) -> DataFrame:
    """finding_id, missing: found findings of several documents of which the matching reports cite some but not all."""
    seen = pairs.join(cites, "tool_index").select("finding_id", "rel_path").distinct().withColumn("seen", F.lit(1))
    wanted = evidence.join(findings.where("multi_document").select("finding_id"), "finding_id").distinct()
    wanted = wanted.join(pairs.select("finding_id").distinct(), "finding_id", "left_semi")
    return wanted.join(seen, ["finding_id", "rel_path"], "left").groupBy("finding_id").agg(F.sum(F.when(F.col("seen").isNull(), 1).otherwise(0)).alias("missing")).where("missing > 0")


def scorecard_diff(baseline_misses: DataFrame, current_misses: DataFrame) -> DataFrame:
    """finding_id, change: gained (missed before, not now) or lost."""
    gained = baseline_misses.subtract(current_misses).withColumn("change", F.lit("gained"))
    return gained.union(current_misses.subtract(baseline_misses).withColumn("change", F.lit("lost")))


def subset_coverage(findings: DataFrame, evidence: DataFrame, subset: DataFrame) -> DataFrame:
    """finding_id, covered: all of a finding's documents are in the subset (relational division)."""
    inside = subset.select("rel_path").distinct().withColumn("inside", F.lit(1))
    counts = evidence.distinct().join(inside, "rel_path", "left").groupBy("finding_id").agg((F.count("inside") == F.count("*")).alias("covered"))
    return findings.select("finding_id").join(counts, "finding_id", "left").select("finding_id", F.coalesce("covered", F.lit(True)).alias("covered"))


def score(reports: DataFrame, findings: DataFrame, evidence: DataFrame, distractors: DataFrame, adjudications: DataFrame | None = None) -> dict[str, DataFrame]:
    """All tables of a scorecard."""
    cites = cited(reports)
    matched = prematch(cites, evidence)
    decided = adjudicated(matched, adjudications) if adjudications is not None else matched.withColumn("corrected", F.lit(False))
    pairs = standing(decided)
    ruled = adjudications.select("tool_index") if adjudications is not None else reports.select("tool_index").limit(0)
    return {
        "matched": decided,
        "unadjudicated": unmatched(reports, matched).join(ruled, "tool_index", "left_anti"),
        "metrics": metrics(findings, reports, pairs),
        "by_severity": recall_by_severity(findings, pairs),
        "distractors": distractor_routing(cites, distractors, pairs),
        "partial": partial_trails(findings, evidence, cites, pairs),
        "misses": misses(findings, pairs),
    }
