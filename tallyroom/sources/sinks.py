"""Writers.  Tables go to new folders only (an existing one is an error); small summaries are text made on the driver."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyroom.functions import text as T
from tallyroom.operators import classify as C
from tallyroom.operators.audit import content_hash

SEVERITIES = ("critical", "high", "medium", "low")


def flagged_tree(blind: DataFrame, evidence: DataFrame, marker: str) -> DataFrame:
    """rel_path, text: documents, with a block of their findings (finding_id, title, substance, rel_path) where they carry some."""
    blocks = evidence.groupBy("rel_path").agg(F.array_sort(F.collect_set(F.struct("finding_id", "title", "substance"))).alias("rows"))
    return blind.join(blocks, "rel_path", "left").select("rel_path", F.when(F.col("rows").isNull(), F.col("text")).otherwise(F.concat("text", T.annotation(F.col("rows"), marker))).alias("text"))


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").csv(path, header=True)


def json_lines(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("errorifexists").text(path)


def manifest(files: DataFrame, room: str, **more) -> str:
    """A room's manifest: its content hash, how many documents, and what else is said; keys are sorted."""
    r = content_hash(files).first()
    return json.dumps({"room": room, "content_hash": r["content_hash"], "documents": r["documents"], **more}, indent=2, sort_keys=True) + "\n"


def read_hash(text: str) -> str:
    """The content hash of a manifest, or an empty text where there is none."""
    try:
        return str(json.loads(text).get("content_hash") or "")
    except (ValueError, AttributeError):
        return ""


def provenance(room_hash: str, said: str) -> str:
    """verified, or unverified where one hash is missing; two different hashes are an error."""
    if room_hash and said and room_hash != said:
        raise ValueError("the output was made from another room")
    return "verified" if room_hash and said else "unverified"


def scorecard_text(tables: dict[str, DataFrame]) -> str:
    """A scorecard as markdown; lists are bounded by the key."""
    m = tables["metrics"].first()
    out = ["# Scorecard", "", f"- recall {m['recall']:.2f} ({m['found']} of {m['n_findings']})", f"- precision {m['precision']:.2f} ({m['matched_reports']} of {m['n_reports']})", "", "| severity | found | total |", "|---|---|---|"]
    bands = {r["severity"]: r for r in tables["by_severity"].collect()}
    out += [f"| {s} | {bands[s]['found']} | {bands[s]['total']} |" for s in SEVERITIES if s in bands]
    for name, column in (("misses", "finding_id"), ("partial", "finding_id"), ("unadjudicated", "tool_index")):
        out += ["", f"{name}: " + (", ".join(str(r[column]) for r in tables[name].orderBy(column).collect()) or "none")]
    routes = tables["distractors"].orderBy("route", "distractor_id").collect()
    for route in ("false alarm", "citation"):
        out += ["", f"{route}s: " + (", ".join(r["distractor_id"] for r in routes if r["route"] == route) or "none")]
    return "\n".join(out) + "\n"


def _share(part: int, whole: int) -> str:
    return f"{part / whole:.0%}" if whole else "-"


def classification_text(pairs: DataFrame, tool: str, said: str, top: int = 15) -> str:
    """A classification's scorecard as markdown: how many types and workstreams are right, each workstream of the key, and the commonest confusions with how many more there are."""
    t = C.totals(pairs).first()
    n = t["documents"]
    out = [f"# Classification scorecard: {tool}", "", f"- provenance: {said}", f"- documents: {n}", f"- document type right: {_share(t['type_correct'], n)} ({t['type_correct']}/{n})",
           f"- workstream right: {_share(t['primary_correct'], n)} ({t['primary_correct']}/{n})", f"- not sure: {t['unsure']} ({_share(t['unsure'], n)})", "",
           "Who else should see a document is routing, not a fact about the room, and is not scored.", "", "| workstream | in the key | recall | filed there | precision |", "|---|---|---|---|---|"]
    part = lambda x: "-" if x is None else f"{x:.0%}"
    out += [f"| {r['workstream']} | {r['relevant']} | {part(r['recall'])} | {r['filed']} | {part(r['precision'])} |" for r in C.per_class(pairs).orderBy("workstream").collect()]
    if wrong := C.confusion_shown(pairs, top).orderBy(F.desc("n"), F.coalesce("expected", F.lit("")), F.coalesce("predicted", F.lit(""))).collect():
        out += ["", "| should be | went to | documents |", "|---|---|---|", *(f"| {r['expected'] or '?'} | {r['predicted'] or '(not sure)'} | {r['n']} |" for r in wrong)]
        out += [f"| … | … | +{wrong[0]['left']} more pairs |"] if wrong[0]["left"] else []
    return "\n".join(out) + "\n"


def findings_text(findings: DataFrame) -> str:
    """The key's findings as markdown, by severity and id."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    rows = findings.orderBy(rank, "finding_id").collect()
    return "# Findings\n" + "".join(f"\n## {r['finding_id']} {r['title']} ({r['severity']})\n\n{r['substance']}\n\nSource: `{r['source']}`, {r['location']}\n" for r in rows)


def distractors_text(distractors: DataFrame) -> str:
    """The key's distractors as markdown, by id."""
    rows = distractors.orderBy("distractor_id").collect()
    return "# Distractors\n" + "".join(f"\n## {r['distractor_id']} {r['title']}\n\nLooks like an issue: `{r['location']}`\n\nResolved by: `{r['resolution']}`\n" + (f"\nShaped like {r['shape_matches']}\n" if r["shape_matches"] else "") for r in rows)


def import_text(output: dict, counts: dict, cut: str, read_named: bool, dropped: list[str] = ()) -> str:
    """An import's summary; what is listed is bounded."""
    out = [f"Imported {counts['issues']} issues ({', '.join(f'{s} {counts[s]}' for s in SEVERITIES)}), citing {counts['cited']} documents.", f"Cut: {cut}, {counts['cut']} documents."]
    if read_named:
        out += [f"Files read: {counts['read']} of {counts['cut']} named; {counts['not_read']} not named, {counts['unexplained']} of them beside one that is.", f"Cited but not named as read: {counts['cited_not_read']}."]
    else:
        out += ["The report does not say which files were read."]
    if dropped:
        out += [f"Dropped, not in the cut: {', '.join(dropped[:10])}" + (f" (+{len(dropped) - 10} more)" if len(dropped) > 10 else "")]
    if counts["uncited"]:
        out += [f"{counts['uncited']} issues cite no document of the cut; only an adjudication can place them."]
    return "\n".join([*out, f"Tool: {output['tool']}"]) + "\n"


def index_sources(slots: DataFrame) -> DataFrame:
    """section, text: one index page a section, its slots (slot_id, rel_path, number, sub, ordinal) in numeric order."""
    name = F.regexp_replace(F.element_at(F.split("rel_path", "/"), -1), r"^[0-9.]+_|\.md$", "")
    line = F.concat(F.lit("- "), "slot_id", F.lit(" "), T.title_case(name))
    rows = slots.select(F.split_part("rel_path", F.lit("/"), F.lit(1)).alias("section"), F.struct("number", "sub", "ordinal", line.alias("line")).alias("x"))
    return rows.groupBy("section").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("text"))
