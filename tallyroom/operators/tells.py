"""Signs in a document's form that give evidence away: bold on the finding, notes that point forward, sections with uneven notes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyroom.functions import text as T

#: Thresholds.
BOLD_OVERLAP, NOTE_GAP, NOTE_MIN_DOCS, HUB_SHARE = 3, 0.5, 3, 0.5


def evidence_roles(findings: DataFrame, distractors: DataFrame) -> DataFrame:
    """rel_path, owner, root, distractor: source (root) and corroboration of findings, location (root) and resolution of distractors."""
    parts = [
        findings.select(F.col("source").alias("rel_path"), F.col("finding_id").alias("owner"), F.lit(True).alias("root"), F.lit(False).alias("distractor")),
        findings.select(F.explode("corroboration"), "finding_id", F.lit(False), F.lit(False)),
        distractors.select("location", "distractor_id", F.lit(True), F.lit(True)),
        distractors.select("resolution", "distractor_id", F.lit(False), F.lit(True)),
    ]
    total = parts[0]
    for p in parts[1:]:
        total = total.union(p)
    return total.distinct()


def direction(source_root: Column, target_root: Column, distractor: Column, source_date: Column, target_date: Column) -> Column:
    """forward, backward or lateral: by construction for a distractor's two ends, else by dates, else by the root."""
    by_end = F.when(source_root, "forward").otherwise("backward")
    by_date = F.when(source_date == target_date, "lateral").when(target_date > source_date, "forward").otherwise("backward")
    return F.when(distractor & (source_root != target_root), by_end).when(source_date.isNotNull() & target_date.isNotNull(), by_date).when(target_root, "backward").otherwise("forward")


def pointers(notes: DataFrame, roles: DataFrame, slot_paths: DataFrame, dates: DataFrame) -> DataFrame:
    """rel_path, line, target, owner, direction of notes (rel_path, line, slot_id) that cite another document of the same owner."""
    cited = notes.join(slot_paths.select("slot_id", F.col("rel_path").alias("target")), "slot_id").where("target <> rel_path")
    own = roles.select("rel_path", "owner", F.col("root").alias("s_root"), "distractor")
    other = roles.select(F.col("rel_path").alias("target"), "owner", F.col("root").alias("t_root"))
    d = lambda p, n: dates.select(F.col("rel_path").alias(p), F.col("date").alias(n))
    both = cited.join(own, "rel_path").join(other, ["target", "owner"]).join(d("rel_path", "s_date"), "rel_path", "left").join(d("target", "t_date"), "target", "left")
    return both.select("rel_path", "line", "target", "owner", direction(F.col("s_root"), F.col("t_root"), F.col("distractor"), F.col("s_date"), F.col("t_date")).alias("direction")).distinct()


def note_asymmetry(docs: DataFrame, min_docs: int = NOTE_MIN_DOCS, gap: float | None = NOTE_GAP) -> DataFrame:
    """section, evidence, evidence_notes, other, other_notes, gap; docs: section, is_evidence, has_note.  With ``gap`` only uneven
    sections with ``min_docs`` documents on both sides."""
    g = docs.groupBy("section").agg(
        F.count_if("is_evidence").alias("evidence"), F.count_if(F.col("is_evidence") & F.col("has_note")).alias("evidence_notes"),
        F.count_if(~F.col("is_evidence")).alias("other"), F.count_if(~F.col("is_evidence") & F.col("has_note")).alias("other_notes"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    g = g.withColumn("gap", F.abs(share("evidence_notes", "evidence") - share("other_notes", "other")))
    return g if gap is None else g.where((F.col("evidence") >= min_docs) & (F.col("other") >= min_docs) & (F.col("gap") >= gap))


def section_habits(cites: DataFrame, docs: DataFrame, share: float = HUB_SHARE, min_docs: int = NOTE_MIN_DOCS) -> DataFrame:
    """section, target, documents: what so many of a section's documents cite that it is habit.  cites: section, rel_path, target; docs: section, rel_path."""
    sizes = docs.groupBy("section").agg(F.countDistinct("rel_path").alias("size"))
    counts = cites.groupBy("section", "target").agg(F.countDistinct("rel_path").alias("documents"))
    return counts.join(sizes, "section").where(F.col("documents") >= F.greatest(F.lit(float(min_docs)), F.col("size") * share)).select("section", "target", "documents")


_FENCE = re.compile(r"^\s*(```|~~~)")
_BOLD = re.compile(r"\*\*(.+?)\*\*|__(.+?)__")
_MARK = re.compile(r"^(\s*)([-*+]|\d+[.)]|\([a-z0-9]+\)|#{1,6})\s+")


def items(docs: DataFrame) -> DataFrame:
    """rel_path, line, kind, group, text, bold (array): list items, table rows and prose lines of markdown, outside
    fences and headings.  Items of one group can be compared.  The state of fences and tables runs through lines, so each text is walked in Python."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, text in zip(pdf["rel_path"], pdf["text"]):
                fenced, table, heading, header = False, 0, 0, False
                for n, line in enumerate((text or "").split("\n"), 1):
                    if _FENCE.match(line):
                        fenced = not fenced
                        continue
                    if fenced or not line.strip():
                        header = False
                        continue
                    if line.lstrip().startswith("|"):
                        cells = [c.strip() for c in line.strip().strip("|").split("|")]
                        if not header:
                            table, header = table + 1, True
                            continue
                        if all(re.fullmatch(r":?-+:?", c) for c in cells) or re.fullmatch(r"\W*(sub)?totals?\W*", cells[0], re.I):
                            continue
                        rows.append((path, n, "row", f"t{table}", " ".join(cells), [a or b for a, b in _BOLD.findall(line)]))
                        continue
                    header = False
                    m = _MARK.match(line)
                    if m and m[2][0] == "#":
                        heading += 1
                        continue
                    bare = line.strip().strip("*_ ")
                    if bare.isupper() or re.fullmatch(r"\s*(\*\*|__)[^*_]+(\*\*|__):?\s*", line):
                        continue  # a title in disguise
                    kind = "item" if m else "line"
                    shape = re.sub(r"[a-z0-9]+", "x", m[2]) if m else ""
                    rows.append((path, n, kind, f"h{heading}{shape}{len(m[1]) if m else ''}", line.strip(), [a or b for a, b in _BOLD.findall(line)]))
            yield pd.DataFrame(rows, columns=["rel_path", "line", "kind", "group", "text", "bold"])

    return docs.select("rel_path", "text").mapInPandas(run, "rel_path string, line int, kind string, group string, text string, bold array<string>")


def italic_notes(docs: DataFrame) -> DataFrame:
    """rel_path, line, slot_id: slots cited in paragraphs set wholly in italics, over several lines too; not the document's own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, text in zip(pdf["rel_path"], pdf["text"]):
                own, at = path.rsplit("/", 1)[-1].split("_")[0], 1
                for block in re.split(r"(\n[ \t]*\n)", text or ""):
                    flat = block.strip()
                    if re.fullmatch(r"(\*(?!\*)[^*]+\*|_(?!_)[^_]+_)", flat, re.S):
                        rows += [(path, at, s) for s in dict.fromkeys(re.findall(T.SLOT, flat)) if s != own]
                    at += block.count("\n")
            yield pd.DataFrame(rows, columns=["rel_path", "line", "slot_id"])

    return docs.select("rel_path", "text").mapInPandas(run, "rel_path string, line int, slot_id string")


def selective_bold(found: DataFrame, roles: DataFrame, overlap: int = BOLD_OVERLAP) -> DataFrame:
    """rel_path, line, span, owner, shared: the bold span of a line that shares most content words with an owner's words, where
    other items of its group are not bold.  found: from ``items``; roles: rel_path, owner, words (array)."""
    groups = found.groupBy("rel_path", "group").agg(F.count("*").alias("n"), F.count_if(F.size("bold") > 0).alias("bolded"))
    uneven = groups.where((F.col("n") > 1) & (F.col("bolded") < F.col("n"))).select("rel_path", "group")
    spans = found.join(uneven, ["rel_path", "group"]).select("rel_path", "line", F.posexplode("bold").alias("pos", "span"))
    met = spans.join(roles, "rel_path").withColumn("shared", F.size(F.array_intersect(T.content_words(F.col("span")), "words"))).where(F.col("shared") >= overlap)
    best = met.groupBy("rel_path", "line").agg(F.max(F.struct("shared", (-F.col("pos")).alias("early"), "owner", "span")).alias("b"))
    return best.select("rel_path", "line", "b.span", "b.owner", "b.shared")
