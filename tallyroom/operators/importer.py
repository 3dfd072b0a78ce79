"""Importing a reviewer's markdown report: citations, sections, and what the import refuses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyroom.sources.room import SEVERITIES, markdown_reports

MAX_CITATIONS = 20
PATH = r"[^\s`\[\]()<>|*\"']+/[^\n`\[\]()<>|*\"']*?\.(?:md|csv|pdf|docx)"
#: Headings that begin asides, and fields of an issue.
ASIDES = r"(?i)^#{1,6}\s*(?:files? (?:read|reviewed)|documents? (?:read|reviewed)|sources?|appendix|method(?:ology)?|limitations?|next steps|summary)\b"


def as_markdown(path: Column) -> Column:
    return F.regexp_replace(path, r"\.(?:pdf|docx)$", ".md")


def normalised(path: Column, sections: list[str]) -> Column:
    """The path from its first section folder on, under its markdown name; unchanged where no part is a section."""
    parts = F.split(F.regexp_replace(F.trim(path), r"\\", "/"), "/")
    at = F.array_position(F.transform(parts, lambda p: p.isin(*sections)), True)
    return as_markdown(F.when(at > 0, F.array_join(F.slice(parts, F.greatest(at, F.lit(1)).cast("int"), F.size(parts)), "/")).otherwise(F.trim(path)))


def citations(text: Column, sections: list[str]) -> Column:
    """Distinct paths of a text, in backticks, links or bare, that lie in a section."""
    found = F.concat(F.regexp_extract_all(text, F.lit(r"`([^`\n]+\.(?:md|csv|pdf|docx))`"), 1), F.regexp_extract_all(F.replace(text, F.lit("%20"), F.lit(" ")), F.lit(PATH), 0))
    return F.array_distinct(F.filter(F.transform(found, lambda p: normalised(p, sections)), lambda p: F.split_part(p, F.lit("/"), F.lit(1)).isin(*sections)))


def key_side(path: Column, sections: list[str], markers: list[str]) -> Column:
    """Whether a folder before the section folder is a marker or says flagged, in any case."""
    parts = F.split(path, "/")
    at = F.array_position(F.transform(parts, lambda p: p.isin(*sections)), True)
    head = F.slice(parts, 1, F.greatest(at - 1, F.lit(0)).cast("int"))
    return F.exists(head, lambda p: F.lower(p).isin(*[m.lower() for m in markers]) | F.contains(F.lower(p), F.lit("flagged")))


def split_report(reports: DataFrame, by: str = "rel_path") -> DataFrame:
    """by, text (issues only), read (the text of asides): a heading of an aside begins one, any other heading ends it."""
    lines = F.split("text", "\n")
    start = F.struct(F.lit(False).alias("aside"), F.array().cast("array<string>").alias("body"), F.array().cast("array<string>").alias("read"))

    def step(acc: Column, line: Column) -> Column:
        aside = F.when(line.rlike(r"^#{1,6}\s"), line.rlike(ASIDES)).otherwise(acc["aside"])
        more = lambda xs, ok: F.when(ok, F.concat(xs, F.array(line))).otherwise(xs)
        return F.struct(aside.alias("aside"), more(acc["body"], ~aside).alias("body"), more(acc["read"], aside).alias("read"))

    done = F.aggregate(lines, start, step)
    return reports.select(by, done.alias("d")).select(by, F.array_join("d.body", "\n").alias("text"), F.array_join("d.read", "\n").alias("read"))


def imported(reports: DataFrame, cut: DataFrame, sections: list[str], markers: list[str] = (), wide: bool = False, by: str = "rel_path") -> dict[str, DataFrame]:
    """issues (by, tool_index, title, severity, documents, summary), refused (by, path or issue, rule), read (paths read) and
    uncited (documents of the cut that no issue cites)."""
    parts = split_report(reports, by)
    issues = markdown_reports(parts, by)
    whole = F.concat_ws("\n", "title", F.array_join(F.transform("documents", lambda p: F.concat(F.lit("`"), p, F.lit("`"))), "\n"), "summary")
    issues = issues.withColumn("raw", F.col("documents")).withColumn("documents", citations(whole, sections))
    cites = issues.select(by, "tool_index", F.explode("documents").alias("path"))
    unknown = cites.join(cut.select(F.col("rel_path").alias("path")).distinct(), "path", "left_anti").select(by, "path", F.lit("not in the cut").alias("rule"))
    keyed = issues.select(by, F.explode("raw").alias("path")).where(key_side(F.col("path"), sections, list(markers) or ["_key"])).select(by, "path", F.lit("on the key's side").alias("rule"))
    broad = issues.where((F.size("documents") > MAX_CITATIONS) & ~F.lit(wide)).select(by, F.col("title").alias("path"), F.lit("cites too many documents").alias("rule"))
    read = parts.select(by, F.explode(citations(F.col("read"), sections)).alias("path")).distinct()
    return {"issues": issues.drop("raw"), "refused": unknown.union(keyed).union(broad).distinct(), "read": read, "uncited": cut.select(F.col("rel_path").alias("path")).distinct().join(cites, "path", "left_anti")}


#: What a report's preamble says of the run.
FIELDS = ("model", "skill")


def preamble_fields(text: Column) -> Column:
    """model and skill that a report names before its first issue ("Model: x", in bold or not; two on one line are told apart), as a struct."""
    head = F.get(F.split(F.concat(F.lit("\n"), text), r"\n#{2,4}(?!#)\s*\S"), F.lit(0))
    names = "|".join(FIELDS)
    one = lambda n: F.trim(F.regexp_replace(F.regexp_extract(head, rf"(?im)^[\s>*_-]*(?:.*?[\s,;|*_])?{n}[*_]*\s*:[*_]*\s*(.*?)(?:[\s,;|*_]+(?:{names})[*_]*\s*:.*)?$", 1), r"^[*_]+|[*_]+$", ""))
    return F.struct(*(one(n).alias(n) for n in FIELDS))


def names_room(preamble: Column, room: str) -> Column:
    """Whether a text names the room as a whole word, in any case."""
    quoted = "\\Q" + room.replace("\\E", "") + "\\E"
    return preamble.rlike(rf"(?i)(?<![\p{{L}}\p{{N}}_]){quoted}(?![\p{{L}}\p{{N}}_])")


def import_counts(parts: dict[str, DataFrame], cut: DataFrame) -> DataFrame:
    """One row of what an import holds: issues (each severity's, and those that cite nothing), documents of the cut, cited, read, not read, not read beside one
    that is, and cited without being read."""
    issues, docs = parts["issues"], cut.select(F.col("rel_path").alias("path")).distinct()
    cited = issues.select(F.explode("documents").alias("path")).distinct().join(docs, "path", "left_semi")
    read = parts["read"].select("path").distinct().join(docs, "path", "left_semi")
    missed = docs.join(read, "path", "left_anti")
    counts = issues.agg(F.count("*").alias("issues"), *(F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES), F.count_if(F.size("documents") == 0).alias("uncited"))
    of = lambda df, name: df.agg(F.count("*").alias(name))
    more = [of(docs, "cut"), of(cited, "cited"), of(read, "read"), of(missed, "not_read"), of(unexplained_misses(missed, read), "unexplained"), of(cited.join(read, "path", "left_anti"), "cited_not_read")]
    for one in more:  # each has one row
        counts = counts.join(one)
    return counts


def unexplained_misses(missed: DataFrame, read: DataFrame) -> DataFrame:
    """Missed evidence paths whose folder holds a document that was read."""
    folder = lambda c: F.regexp_replace(c, "/[^/]*$", "")
    return missed.withColumn("_f", folder(F.col("path"))).join(read.select(folder(F.col("path")).alias("_f")).distinct(), "_f", "left_semi").drop("_f")
