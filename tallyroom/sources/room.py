"""Readers of a room: its configuration, key, document trees, reports and labels.

Small configuration is read by the driver and checked at once; documents and reports are DataFrames.  Files come
through Spark, so they may lie in any store that it reads.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import yaml
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEVERITIES = ("critical", "high", "medium", "low")
REQUIRED = ("ROOM_CODENAME", "INDEX_TOTAL", "BLIND_TOTAL", "FLAGGED_TOTAL", "BLIND_TREE", "FLAGGED_TREE", "KEY_ROOT", "FLAG_STRING_1", "FLAG_STRING_2", "FINDING_PREFIXES", "EXPECTED_KDP_CARRIERS", "SECTION_DIRS")
CHOICES = {"ROOM_ROLE": ("exemplar", "eval"), "SCAN_PROFILE": ("none", "office"), "DOC_LENGTH": ("short", "long")}

FINDING = "finding_id string, title string, severity string, workstream string, multi_document boolean, source string, location string, substance string, corroboration array<string>, cross_links array<string>, discoverable_from_blind boolean, audit_note string"
DISTRACTOR = "distractor_id string, title string, location string, resolution string, shape_matches string"
REPORT = "tool_index int, title string, severity string, documents array<string>, summary string"
CLASSIFIED = "source_path string, document_type string, primary_workstream string, secondary_workstreams array<string>, sent_to_all_workstreams boolean, unsure boolean"


class RoomError(ValueError):
    """A file of the room cannot be used as it is."""


def text_of(spark: SparkSession, path: str) -> str:
    """A small text file, whole."""
    rows = spark.read.text(path, wholetext=True).take(1)
    return rows[0][0] if rows else ""


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on whatever store the path names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


# Trees


def tree(spark: SparkSession, root: str) -> DataFrame:
    """rel_path, suffix, section, slot_id, content, text, valid of every file but .DS_Store; bad bytes are replaced in the text.
    Spark passes files without a byte over."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.substring_index("path", root.rstrip("/").removeprefix("file://") + "/", -1)
    name = F.element_at(F.split(rel, "/"), -1)
    return raw.where(name != ".DS_Store").select(
        rel.alias("rel_path"), F.regexp_extract(name, r"\.[^.]*$", 0).alias("suffix"), F.split_part(rel, F.lit("/"), F.lit(1)).alias("section"),
        F.split_part(F.regexp_replace(name, r"\.[^.]*$", ""), F.lit("_"), F.lit(1)).alias("slot_id"), "content",
        F.make_valid_utf8(F.col("content").cast("string")).alias("text"), F.is_valid_utf8(F.col("content").cast("string")).alias("valid"))


def documents(files: DataFrame) -> DataFrame:
    return files.where(F.col("suffix").isin(".md", ".csv"))


def cut_documents(files: DataFrame) -> DataFrame:
    """Paths of an uploaded cut: nothing below a dotted folder, rendered files under their markdown name."""
    md = F.regexp_replace("rel_path", r"\.(pdf|docx)$", ".md")
    return files.where(~F.col("rel_path").rlike(r"(^|/)\.")).select(md.alias("rel_path")).distinct()


def page_counts(files: DataFrame) -> DataFrame:
    """rel_path, pages of PDF files, counted as page objects in their bytes."""
    return files.where("suffix = '.pdf'").select("rel_path", F.size(F.regexp_extract_all(F.decode("content", "ISO-8859-1"), F.lit(r"/Type\s*/Page(?![A-Za-z])"), 0)).alias("pages"))


def report_text(content: Column) -> Column:
    """A report's text by its byte order mark, with line breaks unified."""
    head = F.hex(F.substring(content, 1, 3))
    text = F.when(head.startswith("FFFE") | head.startswith("FEFF"), F.decode(content, "UTF-16")).when(head == "EFBBBF", F.decode(F.substring(content, 4, 1 << 30), "UTF-8")).otherwise(F.decode(content, "UTF-8"))
    return F.regexp_replace(text, r"\r\n?", "\n")


# Configuration


@dataclass
class RoomConf:
    values: dict[str, str] = field(default_factory=dict)

    def get(self, key: str) -> str:
        if key not in self.values:
            raise RoomError(f"{key} is not set")
        return self.values[key]

    def number(self, key: str) -> int:
        if not re.fullmatch(r"\d+", self.get(key)):
            raise RoomError(f"{key} is no number")
        return int(self.get(key))

    def words(self, key: str) -> list[str]:
        return [x for x in re.split(r"[|\s]+" if key == "FINDING_PREFIXES" else r"\s+", self.get(key)) if x]


def room_conf(text: str) -> RoomConf:
    """KEY="VALUE" lines; comments and blank lines are skipped, a key may be set once."""
    out: dict[str, str] = {}
    for n, line in enumerate(text.splitlines(), 1):
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        m = re.fullmatch(r"""(?:export\s+)?([A-Z][A-Z0-9_]*)=(?:"([^"]*)"|'([^']*)'|([^\s"'#]*))\s*(?:#.*)?""", line)
        if not m:
            raise RoomError(f"line {n} is no assignment")
        if m[1] in out:
            raise RoomError(f"{m[1]} is set twice")
        out[m[1]] = next(x for x in m.groups()[1:] if x is not None)
    if missing := [k for k in REQUIRED if not out.get(k)]:
        raise RoomError(f"missing: {', '.join(missing)}")
    for k, allowed in CHOICES.items():
        if k in out and out[k] not in allowed:
            raise RoomError(f"{k} is none of {', '.join(allowed)}")
    prefixes = RoomConf(out).words("FINDING_PREFIXES")
    if bad := [p for p in prefixes if not re.fullmatch(r"[A-Z][A-Z0-9]*", p)] or len(set(prefixes)) < len(prefixes):
        raise RoomError(f"FINDING_PREFIXES: {bad}")
    return RoomConf(out)


# The key


def _rows(text: str, key: str) -> list[dict]:
    told = yaml.safe_load(text) or {}
    rows = told.get(key, []) if isinstance(told, dict) else told
    if not isinstance(rows, list) or not all(isinstance(r, dict) for r in rows):
        raise RoomError(f"{key} is no list of mappings")
    return rows


def _need(row: dict, *keys: str) -> None:
    for k in keys:
        if row.get(k) in (None, ""):
            raise RoomError(f"{row.get('id', '?')}: {k} is missing")


def findings(spark: SparkSession, text: str) -> DataFrame:
    """The key's findings; required fields, severities and single ids are checked."""
    out, seen = [], set()
    for r in _rows(text, "findings"):
        _need(r, "id", "title", "severity", "workstream", "source", "location", "substance")
        if r["severity"] not in SEVERITIES:
            raise RoomError(f"{r['id']}: no such severity")
        if r["id"] in seen:
            raise RoomError(f"{r['id']} comes twice")
        seen.add(r["id"])
        out.append((r["id"], r["title"], r["severity"], r["workstream"], bool(r.get("multi_document", False)), r["source"], r["location"], r["substance"], list(r.get("corroboration") or []), list(r.get("cross_links") or []), r.get("discoverable_from_blind"), r.get("audit_note")))
    return spark.createDataFrame(out, FINDING)


def distractors(spark: SparkSession, text: str) -> DataFrame:
    out = []
    for r in _rows(text, "distractors"):
        _need(r, "id", "title", "location", "resolution")
        out.append((r["id"], r["title"], r["location"], r["resolution"], r.get("shape_matches")))
    if len({r[0] for r in out}) < len(out):
        raise RoomError("a distractor's id comes twice")
    return spark.createDataFrame(out, DISTRACTOR)


def evidence(found: DataFrame) -> DataFrame:
    """finding_id, rel_path, is_source: a finding's source and corroboration."""
    return found.select("finding_id", F.posexplode(F.concat(F.array("source"), "corroboration")).alias("pos", "rel_path")).select("finding_id", "rel_path", (F.col("pos") == 0).alias("is_source"))


def adjudications(spark: SparkSession, text: str) -> DataFrame:
    """tool_index, finding_ids (sorted; none for null), reason; an index may come once."""
    out = {}
    for r in _rows(text, "adjudications"):
        if not isinstance(r.get("tool_index"), int) or "finding_id" not in r:
            raise RoomError("an adjudication needs tool_index and finding_id")
        if r["tool_index"] in out:
            raise RoomError(f"index {r['tool_index']} is adjudicated twice")
        ids = r["finding_id"]
        out[r["tool_index"]] = (r["tool_index"], sorted(set([] if ids is None else [ids] if isinstance(ids, str) else ids)), r.get("reason"))
    return spark.createDataFrame(list(out.values()), "tool_index int, finding_ids array<string>, reason string")


def adjudication_violations(rulings: DataFrame, reports: DataFrame, found: DataFrame) -> DataFrame:
    """(tool_index, rule) of rulings on unknown reports or findings."""
    lost = rulings.join(reports, "tool_index", "left_anti").select("tool_index", F.lit("no such report").alias("rule"))
    unknown = rulings.select("tool_index", F.explode("finding_ids").alias("finding_id")).join(found, "finding_id", "left_anti").select("tool_index", F.lit("no such finding").alias("rule"))
    return lost.union(unknown)


# Reports


def tool_reports(spark: SparkSession, path: str) -> DataFrame:
    """Reports of a tool's JSON file; the place in the list is the key, a missing severity is medium."""
    kind = "tool string, room_hash string, findings array<struct<title: string, severity: string, documents: array<string>, summary: string>>"
    raw = spark.read.schema(kind).option("mode", "FAILFAST").json(path, multiLine=True)
    one = raw.select(F.posexplode("findings").alias("tool_index", "f"))
    return one.select("tool_index", F.coalesce("f.title", F.lit("")).alias("title"), F.coalesce("f.severity", F.lit("medium")).alias("severity"), F.coalesce("f.documents", F.array().cast("array<string>")).alias("documents"), F.coalesce("f.summary", F.lit("")).alias("summary"))


def report_hash(spark: SparkSession, path: str) -> str:
    """The room hash that a tool's JSON output names, or an empty text; other forms have no place for one."""
    if path.endswith((".md", ".docx")):
        return ""
    row = spark.read.schema("room_hash string").json(path, multiLine=True).first()
    return (row["room_hash"] if row else "") or ""


def markdown_reports(texts: DataFrame, by: str = "rel_path") -> DataFrame:
    """by, tool_index, title, severity, documents, summary of markdown reports: a heading of level 2 to 4 begins one; what is
    below it tells the rest: the first severity word counts, else medium; documents are the paths in backticks, as often as
    they are named; the summary is the first 400 characters.  A text without such a heading has no rows."""
    w = Window.partitionBy(by).orderBy("pos")
    numbered = texts.select(by, F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    heading = F.col("line").rlike(r"^#{2,4}(?!#)\s*\S")
    grouped = numbered.withColumn("issue", F.sum(F.when(heading, 1).otherwise(0)).over(w)).where("issue > 0").groupBy(by, "issue").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("ls"))
    lines = F.transform("ls", lambda x: x["line"])
    body = F.array_join(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), "\n")
    severity = F.lower(F.regexp_extract(body, r"(?i)\b(critical|high|medium|low)\b", 1))
    return grouped.select(by, (F.col("issue") - 1).cast("int").alias("tool_index"), F.trim(F.regexp_replace(lines[0], r"^#+\s*", "")).alias("title"), F.when(severity == "", "medium").otherwise(severity).alias("severity"),
        F.regexp_extract_all(body, F.lit(r"`([\p{L}\p{N}_./-]+\.(?:md|csv|pdf|docx))`"), 1).alias("documents"), F.left(F.trim(F.regexp_replace(body, r"\s+", " ")), F.lit(400)).alias("summary"))


def reports_of(spark: SparkSession, path: str) -> DataFrame:
    """Reports of a tool's output, JSON or markdown.  Markdown without a finding is an error; a tool that found nothing says so in JSON."""
    if not path.endswith(".md"):
        return tool_reports(spark, path)
    out = markdown_reports(spark.createDataFrame([(path, text_of(spark, path))], "rel_path string, text string")).drop("rel_path")
    if out.isEmpty():
        raise RoomError("no finding in this markdown report: each is a heading of level 2 to 4")
    return out


def classifications(spark: SparkSession, path: str) -> DataFrame:
    """Classified rows of a JSON object's list or of JSON lines; a path must be there, and once."""
    lines = path.endswith(".jsonl")
    if lines:
        rows = spark.read.schema(CLASSIFIED).option("mode", "FAILFAST").json(path)
    else:
        rows = spark.read.schema(f"tool string, room_hash string, classifications array<struct<{', '.join(x.replace(' ', ': ', 1) for x in CLASSIFIED.split(', '))}>>").option("mode", "FAILFAST").json(path, multiLine=True).select(F.explode("classifications").alias("c")).select("c.*")
    if not rows.where("source_path IS NULL OR source_path = ''").isEmpty():
        raise RoomError("a row has no source_path")
    if twice := rows.groupBy("source_path").count().where("count > 1").select("source_path").take(3):
        raise RoomError(f"classified twice: {', '.join(r[0] for r in twice)}")
    return rows


def agreed_hash(rows: DataFrame) -> str:
    """The one room hash that the rows name, or an empty text."""
    found = [r[0] for r in rows.select("room_hash").where("room_hash <> ''").distinct().take(2)]
    if len(found) > 1:
        raise RoomError("rows name different rooms")
    return found[0] if found else ""


def labels(spark: SparkSession, text: str) -> DataFrame:
    rows = [(r["path"], r["document_type"]) for r in _rows(text, "labels")]
    if len({r[0] for r in rows}) < len(rows):
        raise RoomError("a path is labelled twice")
    return spark.createDataFrame(rows, "path string, document_type string")


def label_rows(spark: SparkSession, text: str) -> DataFrame:
    """path, document_type as they are written, gaps and repeats included; those are the key builder's to judge."""
    said = lambda x: None if x is None else str(x)
    return spark.createDataFrame([(said(r.get("path")), said(r.get("document_type"))) for r in _rows(text, "labels")], "path string, document_type string")


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where("trim(value) <> '' AND NOT startswith(ltrim(value), '#')").select(F.col("value").alias("name")).distinct()


def slots(spark: SparkSession, path: str) -> DataFrame:
    """slot_id, tier, rel_path, section, subsection of a manifest."""
    raw = spark.read.schema("slot_id string, tier string, rel_path string").csv(path, header=True)
    parts = F.split("rel_path", "/")
    return raw.select("*", F.get(parts, F.lit(0)).alias("section"), F.regexp_replace(F.get(parts, F.lit(1)), r"^[0-9.]+_", "").alias("subsection"))


def table_rows(text: Column, prefix: str) -> Column:
    """Cells of the pipe-table rows below level-2 headings that begin so; rulers are left out."""
    parts = F.filter(F.split(F.concat(F.lit("\n"), text), r"\n## "), lambda p: F.startswith(F.lower(p), F.lit(prefix.lower())))
    lines = F.filter(F.flatten(F.transform(parts, lambda p: F.split(p, "\n"))), lambda x: F.ltrim(x).startswith("|") & ~x.rlike(r"^[\s|:-]+$"))
    return F.transform(lines, lambda x: F.transform(F.split(F.regexp_replace(F.trim(x), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c)))


def canonical_figures(spark: SparkSession, fact_sheet: str) -> DataFrame:
    """key, value, superseded (array) of a fact sheet; a dash means none."""
    rows = spark.createDataFrame([(fact_sheet,)], "text string").select(F.explode(table_rows(F.col("text"), "Canonical figures")).alias("c")).where("size(c) >= 2 AND lower(c[0]) <> 'key'")
    third = F.coalesce(F.get("c", F.lit(2)), F.lit(""))
    old = F.filter(F.transform(F.split(third, ";"), lambda x: F.trim(x)), lambda x: x != "")
    return rows.select(F.col("c")[0].alias("key"), F.col("c")[1].alias("value"), F.when(third.rlike(r"^[\p{Pd}−\s\p{Z}]*$"), F.array().cast("array<string>")).otherwise(old).alias("superseded"))


def cast_names(spark: SparkSession, text: str, heading: str = "Cast") -> DataFrame:
    rows = spark.createDataFrame([(text,)], "text string").select(F.explode(table_rows(F.col("text"), heading)).alias("c"))
    return rows.where("lower(c[0]) <> 'name'").select(F.col("c")[0].alias("name"), F.coalesce(F.get("c", F.lit(1)), F.lit("")).alias("kind")).distinct()


def name_verdicts(spark: SparkSession, text: str) -> DataFrame:
    """name, kind, verdict, checked, note of a name-check table (four cells at least)."""
    line = F.filter(F.split("text", "\n"), lambda x: F.ltrim(x).startswith("|") & ~x.rlike(r"^[\s|:-]+$"))
    rows = spark.createDataFrame([(text,)], "text string").select(F.explode(F.transform(line, lambda x: F.transform(F.split(F.regexp_replace(F.trim(x), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c)))).alias("c"))
    return rows.where("size(c) >= 4 AND lower(c[0]) <> 'name'").select(*(F.col("c")[i].alias(n) for i, n in enumerate(("name", "kind", "verdict", "checked"))), F.coalesce(F.get("c", F.lit(4)), F.lit("")).alias("note"))


def gaps(text: str) -> list[str]:
    return sorted({str(r["ref"]) for r in _rows(text, "gaps")})


def sections(spark: SparkSession, text: str) -> DataFrame:
    """The domain's sections; weights sum to one."""
    rows = _rows(text, "sections")
    if abs(sum(float(r["weight"]) for r in rows) - 1) > 1e-6:
        raise RoomError("weights do not sum to 1")
    return spark.createDataFrame([(int(r["number"]), r["dir_name"], r["title"], r["workstream"], float(r["weight"]), list(r["subsections"]), bool(r.get("core", False)), r.get("classifier_workstream")) for r in rows], "number long, dir_name string, title string, workstream string, weight double, subsections array<string>, core boolean, classifier_workstream string")


#: Whose paper a document is.
PAPERS = ("target", "counterparty")


def lengths(spark: SparkSession, text: str, anatomy: str | None = None) -> DataFrame:
    """section, subsection, band, paper, anatomy, floor, target of a domain's lengths; its bands, shares and rows are held to their rules."""
    told = yaml.safe_load(text) or {}
    words, bands = told.get("words_per_page"), told.get("bands") or {}
    for name, b in bands.items():
        low, high = b["pages"]
        if not (0 < low < high and b["floor"] == low * words and b["floor"] < b["target"] <= high * words):
            raise RoomError(f"band {name}: pages must rise, the floor be that of the least pages, and the target lie above it, but not beyond the most")
    kinds = (yaml.safe_load(anatomy) or {}).get("families", {}) if anatomy else None
    for name, k in (kinds or {}).items():
        shares = [p["share"] for p in k.get("parts") or []]
        if not shares or not k.get("clauses") or sum(shares) != 100 or min(shares) <= 0:
            raise RoomError(f"anatomy {name}: it needs clauses, and parts with shares that sum to 100")
    out = {}
    for r in told.get("subsections") or []:
        at = (r["section"], r["subsection"])
        if at in out:
            raise RoomError(f"{'/'.join(at)} is declared twice")
        if r["band"] not in bands or r["paper"] not in PAPERS or kinds is not None and r["anatomy"] not in kinds:
            raise RoomError(f"{'/'.join(at)}: no such band, paper or anatomy")
        out[at] = (*at, r["band"], r["paper"], r["anatomy"], bands[r["band"]]["floor"], bands[r["band"]]["target"])
    return spark.createDataFrame(list(out.values()), "section string, subsection string, band string, paper string, anatomy string, floor int, target int")


def length_violations(rows: DataFrame, all_sections: DataFrame, short_floors: DataFrame) -> DataFrame:
    """(section, subsection, problem) of lengths whose subfolder the domain does not have, or that ask less of a slot than a short room does (section, subsection, floor)."""
    there = all_sections.select(F.col("dir_name").alias("section"), F.explode("subsections").alias("subsection"), F.lit(True).alias("there"))
    told = rows.join(there, ["section", "subsection"], "left").join(short_floors.select("section", "subsection", F.col("floor").alias("short")), ["section", "subsection"], "left")
    problem = F.when(F.col("there").isNull(), "no such subsection").when(F.col("floor") < F.col("short"), "below the floor of a short room")
    return told.select("section", "subsection", problem.alias("problem")).where("problem IS NOT NULL")


def section_subset(all_sections: DataFrame, chosen: list[str]) -> DataFrame:
    """Chosen sections with weights scaled to one; core sections must be among them."""
    if not all_sections.where(F.col("core") & ~F.col("dir_name").isin(*chosen)).isEmpty():
        raise RoomError("a core section is left out")
    some = all_sections.where(F.col("dir_name").isin(*chosen))
    return some.withColumn("weight", F.col("weight") / F.sum("weight").over(Window.partitionBy()))
