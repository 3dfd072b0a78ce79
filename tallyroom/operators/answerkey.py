"""Building the classification key: what each document is (its label) and which workstream its section belongs to.

A key covers every document or is refused.  Every rule is checked for every row at once; what breaks a rule is a row
of one table, from which counts and first examples of each rule come, however many rows break it.

Documents: (rel_path).  Labels: (path, document_type), as written.  Sections: (dir_name, classifier_workstream).  Vocabulary: (name).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyroom.functions.text import json_quoted

#: Examples of a rule's breaches that are named.
SHOWN = 10

RULES = ("incomplete label", "labelled twice", "outside the vocabulary", "without a label", "without a document", "unknown section", "section without a workstream")


def sections_of(paths: DataFrame, sections: DataFrame, path: str = "rel_path") -> DataFrame:
    """Adds ``section`` (dir_name) and the section's other columns: of the longest section directory that leads to the path, else null.

    Every directory above a path is looked up by equality."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    rest = [c for c in sections.columns if c != "dir_name"]
    offered = sections.select(F.col("dir_name").alias("_above"), F.struct(F.length("dir_name").alias("size"), F.col("dir_name").alias("section"), *rest).alias("_s"))
    near = paths.select(path).where(F.col(path).isNotNull()).distinct().select(path, F.explode(above).alias("_above")).join(offered, "_above")
    best = near.groupBy(path).agg(F.max_by("_s", "_s.size").alias("_s"))
    return paths.join(best, path, "left").select(*paths.columns, "_s.section", *(F.col("_s")[c].alias(c) for c in rest))


def judged(docs: DataFrame, labels: DataFrame, sections: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """rel_path, document_type, workstream, section, breaches (array of rule and detail): a row for each document or labelled path."""
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    given = labels.select(F.col("path").alias("rel_path"), "document_type").withColumn("bad", empty("rel_path") | empty("document_type"))
    said = given.groupBy("rel_path").agg(F.count("*").alias("n"), F.max("bad").alias("bad"), F.min("document_type").alias("document_type"))
    both = docs.select("rel_path").distinct().withColumn("is_document", F.lit(True)).join(said, "rel_path", "full")
    listed = F.lit(True)
    if vocabulary is not None:
        both = both.join(vocabulary.select(F.col("name").alias("document_type"), F.lit(True).alias("listed")).distinct(), "document_type", "left")
        listed = F.coalesce("listed", F.lit(False))
    placed = sections_of(both, sections.select("dir_name", "classifier_workstream"))
    document, labelled, bad = F.col("is_document").isNotNull(), F.col("n").isNotNull(), F.coalesce("bad", F.lit(False))
    path, home = F.col("rel_path"), F.split_part("rel_path", F.lit("/"), F.lit(1))
    breach = lambda broken, rule, detail: F.when(broken, F.struct(F.lit(rule).alias("rule"), detail.alias("detail")))
    rules = F.array(
        breach(bad, RULES[0], F.coalesce(path, F.lit(""))),
        breach(F.col("n") > 1, RULES[1], path),
        breach(labelled & ~bad & ~listed, RULES[2], F.col("document_type")),
        breach(document & ~labelled, RULES[3], path),
        breach(labelled & ~document & ~empty("rel_path"), RULES[4], path),
        breach(document & F.col("section").isNull(), RULES[5], home),
        breach(document & F.col("section").isNotNull() & empty("classifier_workstream"), RULES[6], F.col("section")),
    )
    return placed.select("rel_path", "document_type", F.col("classifier_workstream").alias("workstream"), "section", F.filter(rules, lambda b: b.isNotNull()).alias("breaches"))


def named(rows: DataFrame, by: str, detail: str, shown: int = SHOWN) -> DataFrame:
    """by, n, named: how many different details each has, and the first ``shown`` of them as text, with the number of those left out."""
    distinct = rows.select(by, detail).distinct()
    counts = distinct.groupBy(by).agg(F.count("*").alias("n"))
    first = distinct.withColumn("_k", F.row_number().over(Window.partitionBy(by).orderBy(detail))).where(F.col("_k") <= shown)  # Spark cuts to so many before it shuffles
    texts = first.groupBy(by).agg(F.array_join(F.array_sort(F.collect_list(detail)), ", ").alias("_t"))
    more = F.when(F.col("n") > shown, F.concat(F.lit(" (+"), (F.col("n") - shown).cast("string"), F.lit(" more)"))).otherwise("")
    return counts.join(texts, by).select(by, "n", F.concat("_t", more).alias("named"))


def breaches(rows: DataFrame, shown: int = SHOWN) -> DataFrame:
    """rule, n, named of ``judged`` rows."""
    return named(rows.select(F.explode("breaches").alias("b")).select("b.rule", "b.detail"), "rule", "detail", shown)


def records(rows: DataFrame) -> DataFrame:
    """The key's records of ``judged`` rows that break no rule; who else should see a document is no fact about it, so that list is empty."""
    return rows.where(F.size("breaches") == 0).select(F.col("rel_path").alias("source_path"), "document_type", F.col("workstream").alias("primary_workstream"), F.array().cast("array<string>").alias("secondary_workstreams"))


def record_line(path: Column, kind: Column, workstream: Column) -> Column:
    """A record as a line of JSON in ASCII, its fields in fixed order, a space behind colons and commas."""
    return F.concat(F.lit('{"source_path": '), json_quoted(path), F.lit(', "document_type": '), json_quoted(kind), F.lit(', "primary_workstream": '), json_quoted(workstream), F.lit(', "secondary_workstreams": []}'))


def label_drift(labels: DataFrame, vocabulary: DataFrame, shown: int = SHOWN) -> DataFrame:
    """document_type, n, named: types outside the vocabulary and the paths that have them.  Nothing is normalised."""
    unknown = labels.join(vocabulary.select(F.col("name").alias("document_type")), "document_type", "left_anti")
    return named(unknown, "document_type", "path", shown)


def outside_sections(findings: DataFrame, distractors: DataFrame, sections: DataFrame) -> DataFrame:
    """rel_path of evidence, and of both ends of distractors, whose first directory is no declared section (dir_name)."""
    paths = findings.select(F.col("source").alias("rel_path")).union(findings.select(F.explode("corroboration"))).union(distractors.select("location")).union(distractors.select("resolution"))
    homes = paths.where("rel_path IS NOT NULL").distinct().withColumn("dir_name", F.split_part("rel_path", F.lit("/"), F.lit(1)))
    return homes.join(sections.select("dir_name").distinct(), "dir_name", "left_anti").select("rel_path")
