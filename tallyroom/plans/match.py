"""Queries of the matching family: orders are reports, their parts the cited documents, a brand's small parts its evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyroom.operators import match as M


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _reports(s, d):
    return _table(s, d, "orders").select(F.col("o_orderkey").alias("tool_index"))


def _cites(s, d):
    return _table(s, d, "lineitem").select(F.col("l_orderkey").alias("tool_index"), F.col("l_partkey").alias("rel_path"))


def _evidence(s, d):
    return _table(s, d, "part").where("p_size <= 2").select(F.col("p_brand").alias("finding_id"), F.col("p_partkey").alias("rel_path"))


def _band():
    last = F.right("p_brand", F.lit(1)).cast("int") % 3
    return F.when(last == 0, "critical").when(last == 1, "high").otherwise("medium")


def _findings(s, d):
    return _table(s, d, "part").select(F.col("p_brand").alias("finding_id"), _band().alias("severity"), F.lit(True).alias("multi_document")).distinct()


def _fine():
    return F.concat("p_brand", F.lit(" "), "p_type")


def _fine_findings(s, d):
    """A finding for each brand and type, most of which have few documents."""
    return _table(s, d, "part").select(_fine().alias("finding_id"), _band().alias("severity"), F.lit(True).alias("multi_document")).distinct()


def _fine_pairs(s, d, cites):
    return M.matches(cites, _table(s, d, "part").where("p_size <= 3").select(_fine().alias("finding_id"), F.col("p_partkey").alias("rel_path")))


def _tool(s, d, quantities: str):
    """The citations of one of two tools: together all there are."""
    return _table(s, d, "lineitem").where(f"l_quantity {quantities}").select(F.col("l_orderkey").alias("tool_index"), F.col("l_partkey").alias("rel_path"))


def _trails(s, d):
    """Evidence of which the smallest parts also name a document that nobody cites."""
    some = _evidence(s, d)
    return some.union(_table(s, d, "part").where("p_size = 1").select("p_brand", -F.col("p_partkey")))


def _distractors(s, d):
    return _table(s, d, "part").where("p_size = 3").select(F.concat(F.lit("DX-"), F.col("p_partkey").cast("string")).alias("distractor_id"), F.col("p_partkey").alias("location"))


def _adjudications(s, d):
    key = F.col("o_orderkey")
    ids = F.when(key % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("Brand#11"), F.lit("Brand#23")))
    return _table(s, d, "orders").where((key % 7 == 0) | (key % 11 == 0)).select(key.alias("tool_index"), ids.alias("finding_ids"))


def _pairs(s, d):
    return M.matches(_cites(s, d), _evidence(s, d))


def prematch_reports(s, d):
    return M.prematch(_cites(s, d), _evidence(s, d)).select("tool_index", F.array_join("finding_ids", ",").alias("finding_ids"))


def unmatched_reports(s, d):
    return M.unmatched(_reports(s, d), _pairs(s, d))


def scorecard_metrics(s, d):
    return M.metrics(_findings(s, d), _reports(s, d), _pairs(s, d))


def recall_by_band(s, d):
    return M.recall_by_severity(_fine_findings(s, d), _fine_pairs(s, d, _cites(s, d)))


def missed_findings(s, d):
    return M.misses(_fine_findings(s, d), _fine_pairs(s, d, _cites(s, d)))


def partial_trails(s, d):
    cites, trails = _cites(s, d), _trails(s, d)
    return M.partial_trails(_findings(s, d), trails, cites, M.matches(cites, trails))


def false_alarm_routing(s, d):
    return M.distractor_routing(_cites(s, d), _distractors(s, d), _pairs(s, d))


def scorecard_diff(s, d):
    before, after = (M.misses(_fine_findings(s, d), _fine_pairs(s, d, _tool(s, d, quantities))) for quantities in ("<= 1", "> 1"))
    return M.scorecard_diff(before, after)


def adjudication_override(s, d):
    decided = M.adjudicated(M.prematch(_cites(s, d), _evidence(s, d)), _adjudications(s, d))
    return decided.select("tool_index", F.array_join("finding_ids", ",").alias("finding_ids"), "corrected")


def subset_coverage(s, d):
    return M.subset_coverage(_findings(s, d), _evidence(s, d), _cites(s, d).where("tool_index % 3 = 0"))


QUERIES = {f.__name__: f for f in (prematch_reports, unmatched_reports, scorecard_metrics, recall_by_band, missed_findings, partial_trails, false_alarm_routing, scorecard_diff, adjudication_override, subset_coverage)}

_BASE = """
WITH cites AS (SELECT l_orderkey AS tool_index, l_partkey AS rel_path FROM lineitem),
evidence AS (SELECT p_brand AS finding_id, p_partkey AS rel_path FROM part WHERE p_size <= 2),
findings AS (SELECT DISTINCT p_brand AS finding_id, CASE right(p_brand, 1)::INT % 3 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' ELSE 'medium' END AS severity FROM part),
pairs AS (SELECT DISTINCT tool_index, finding_id FROM cites JOIN evidence USING (rel_path)),
fine AS (SELECT p_brand || ' ' || p_type AS finding_id, p_partkey, p_size, CASE right(p_brand, 1)::INT % 3 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' ELSE 'medium' END AS severity FROM part),
fine_findings AS (SELECT DISTINCT finding_id, severity FROM fine),
fine_found AS (SELECT DISTINCT finding_id, l_quantity <= 1 AS first FROM fine JOIN lineitem ON l_partkey = p_partkey WHERE p_size <= 3),
prematch AS (SELECT tool_index, array_to_string(list_sort(list(finding_id)), ',') AS finding_ids FROM pairs GROUP BY 1)
"""

ORACLE = {
    "prematch_reports": _BASE + "SELECT * FROM prematch",
    "unmatched_reports": _BASE + "SELECT o_orderkey AS tool_index FROM orders WHERE o_orderkey NOT IN (SELECT tool_index FROM pairs)",
    "scorecard_metrics": _BASE + """, n AS (SELECT (SELECT count(DISTINCT finding_id) FROM pairs) AS found, (SELECT count(*) FROM findings) AS n_findings,
        (SELECT count(DISTINCT tool_index) FROM pairs) AS matched_reports, (SELECT count(*) FROM orders) AS n_reports)
        SELECT *, found / n_findings AS recall, matched_reports / n_reports AS "precision" FROM n""",
    "recall_by_band": _BASE + """SELECT b.severity, count(f4.finding_id) AS found, count(f.finding_id) AS total
        FROM (VALUES ('critical'), ('high'), ('medium'), ('low')) b(severity) LEFT JOIN fine_findings f USING (severity) LEFT JOIN (SELECT DISTINCT finding_id FROM fine_found) f4 ON f4.finding_id = f.finding_id GROUP BY 1""",
    "missed_findings": _BASE + "SELECT finding_id FROM fine_findings ANTI JOIN fine_found USING (finding_id)",
    "partial_trails": _BASE + """, trails AS (SELECT * FROM evidence UNION SELECT p_brand, -p_partkey FROM part WHERE p_size = 1),
        seen AS (SELECT DISTINCT finding_id, rel_path FROM pairs JOIN cites USING (tool_index))
        SELECT finding_id, count(*) AS missing FROM trails e SEMI JOIN pairs USING (finding_id) ANTI JOIN seen s ON s.finding_id = e.finding_id AND s.rel_path = e.rel_path GROUP BY 1""",
    "false_alarm_routing": _BASE + """SELECT DISTINCT 'DX-' || p_partkey AS distractor_id, CASE WHEN tool_index IN (SELECT tool_index FROM pairs) THEN 'citation' ELSE 'false alarm' END AS route
        FROM cites JOIN part ON p_partkey = rel_path WHERE p_size = 3""",
    "scorecard_diff": _BASE + """, a AS (SELECT finding_id FROM fine_findings ANTI JOIN (SELECT * FROM fine_found WHERE first) USING (finding_id)), b AS (SELECT finding_id FROM fine_findings ANTI JOIN (SELECT * FROM fine_found WHERE NOT first) USING (finding_id))
        SELECT finding_id, 'gained' AS change FROM a ANTI JOIN b USING (finding_id) UNION ALL SELECT finding_id, 'lost' FROM b ANTI JOIN a USING (finding_id)""",
    "adjudication_override": _BASE + """, ruled AS (SELECT o_orderkey AS tool_index, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'Brand#11,Brand#23' END AS ruled FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 11 = 0)
        SELECT tool_index, coalesce(ruled, finding_ids) AS finding_ids, ruled IS NOT NULL AND finding_ids IS NOT NULL AS corrected FROM prematch FULL JOIN ruled USING (tool_index)""",
    "subset_coverage": _BASE + """SELECT finding_id, coalesce(bool_and(inside), true) AS covered FROM findings LEFT JOIN
        (SELECT finding_id, rel_path IN (SELECT rel_path FROM cites WHERE tool_index % 3 = 0) AS inside FROM evidence) USING (finding_id) GROUP BY 1""",
}
